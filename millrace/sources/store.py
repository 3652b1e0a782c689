"""Stored tables: Parquet parts plus a commit log.

Layout under the project root::

    schemas/<table>.schema.json            target schema (optional)
    data/<table>/part-<n>-<kind>-<tag>/    Parquet written by commit n
    data/<table>/_log/<n>.json             parts, layout and facts of commit n
    data/<table>/_log/_newest              number of a recent commit
    backup/<table>/<time>_<n>/             timestamped copies

The newest log entry names the parts that make up the table, so a failed or
racing write is never seen. It is found from a recent number on, whatever the
length of the log. Part folders are immutable:

* appends add one part and leave the rest alone;
* a keyed table beyond ``bucket_bytes`` lies in hash buckets of its key, one
  folder each in every part. Commits look keys up in the buckets of the batch's
  keys alone, and upserts rewrite these buckets; the log entry says which buckets
  of a part still count, however many files they have;
* versioned tables only ever add parts. Every ``snapshot_every`` commits the
  newest row of each key is written aside; reads of the current state and lookups
  of later commits take this snapshot and the parts after it. The log knows when
  each part was committed, and compaction closes each row's interval of validity,
  so a read as of a moment opens no part that is younger.

A batch is computed once, into a part folder, before it is merged. That cuts
its lineage, gives its exact row count, and gives Catalyst its true size when
it chooses between broadcasting and shuffling the batch's keys.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Mapping, Sequence
from datetime import datetime
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cells import nan_to_null
from millrace.functions.names import key_list, named
from millrace.operators import merge, versions
from millrace.operators.shape import cast_to, conform
from millrace.schema import TableSchema
from millrace.sources import files

FORMAT = "1"
_BUCKET = "__bucket"
#: Intervals of validity, held by compacted parts of versioned tables only.
_FROM, _TO = "_valid_from", "_valid_to"


class Backend(Enum):
    """How a store merges."""

    PARQUET = "parquet"  # whole-row merge, repeats in a batch stay
    PARQUET_VERSIONED = "parquet_versioned"  # every version kept
    SQL = "sql"  # INSERT OR IGNORE / ON CONFLICT DO UPDATE semantics


# Policy names and how they are spelled in settings.
class WritePolicy(Enum):
    APPEND = "append"
    UPSERT = "upsert"


class BackupPolicy(Enum):
    NONE = "none"
    TIMESTAMPED_COPIES = "timestamped_copies"


class CommitConflict(RuntimeError):
    """Another writer committed to the table first; read again and retry."""


LOG_LAYOUT = T.StructType(
    [
        T.StructField("format", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("last_updated", T.StringType()),
        T.StructField("backend", T.StringType()),
        T.StructField("policy", T.StringType()),
        T.StructField("parts", T.ArrayType(T.StringType())),
        T.StructField("layout", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("batches", T.MapType(T.StringType(), T.LongType())),
    ]
)


def _from_records(
    spark: SparkSession, records: list[dict], schema: TableSchema | None
) -> DataFrame:
    """Hand-edited records as a frame, typed by the schema where there is one."""
    names = list(dict.fromkeys(c for r in records for c in r))
    if schema is None:
        return spark.createDataFrame([tuple(r.get(c) for c in names) for r in records], names)
    layout = schema.struct(names)
    floats = {f.name for f in layout.fields if isinstance(f.dataType, T.DoubleType)}
    rows = [
        tuple(
            float(r[c]) if c in floats and r.get(c) is not None else r.get(c)
            for c in names
        )
        for r in records
    ]
    return spark.createDataFrame(rows, layout)


class TableStore:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        backend: Backend = Backend.PARQUET,
        write_policy: WritePolicy = WritePolicy.UPSERT,
        backup_policy: BackupPolicy = BackupPolicy.NONE,
        storage: str = "text",
        extra: str = "drop",
        tombstone: str = "hide",
        bucket_bytes: int = 128 << 20,
        snapshot_every: int = 16,
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.backend = Backend(backend)
        self.storage = storage
        self.extra = extra
        self.tombstone = tombstone
        self.bucket_bytes = bucket_bytes
        self.snapshot_every = snapshot_every
        self.set_write_policy(write_policy)
        self.set_backup_policy(backup_policy)

    # -- policies and schemas ------------------------------------------------

    def set_write_policy(self, policy: WritePolicy) -> None:
        if not isinstance(policy, WritePolicy):
            raise ValueError(f"not a write policy: {policy!r}")
        self.write_policy = policy

    def set_backup_policy(self, policy: BackupPolicy) -> None:
        if not isinstance(policy, BackupPolicy):
            raise ValueError(f"not a backup policy: {policy!r}")
        self.backup_policy = policy

    def _schema_path(self, table: str, relaxed: bool = False) -> str:
        suffix = "schema.relaxed.json" if relaxed else "schema.json"
        return f"{self.root}/schemas/{table}.{suffix}"

    def put_schema(self, table: str, document: dict, relaxed: bool = False) -> None:
        files.write_text(
            self.spark, self._schema_path(table, relaxed), json.dumps(document)
        )

    def schema(self, table: str, relaxed: bool = False) -> TableSchema | None:
        """The table's schema, or None when no schema file exists."""
        path = self._schema_path(table, relaxed)
        if not files.exists(self.spark, path):
            return None
        return TableSchema(files.read_text(self.spark, path), self.storage)

    def key(self, table: str) -> str | None:
        schema = self.schema(table)
        return schema.key if schema else None

    # -- log -----------------------------------------------------------------

    def _folder(self, table: str) -> str:
        return f"{self.root}/data/{table}"

    def _latest(self, table: str) -> dict | None:
        """The newest log entry, from a recent one on. Only without a trace of that
        the whole log is listed."""
        folder = f"{self._folder(table)}/_log"
        entry = lambda n: f"{folder}/{n:012d}.json"
        try:
            newest = int(files.read_text(self.spark, f"{folder}/_newest"))
        except Exception:  # not there, or being written
            newest = None
        if newest is None or not files.exists(self.spark, entry(newest)):
            found = [n for n in files.names(self.spark, folder) if n[0].isdigit()]
            if not found:
                return None
            newest = int(found[-1].partition(".")[0])
        while files.exists(self.spark, entry(newest + 1)):
            newest += 1
        return json.loads(files.read_text(self.spark, entry(newest)))

    def tables(self) -> list[str]:
        folder = f"{self.root}/data"
        return [t for t in files.names(self.spark, folder) if self._latest(t)]

    def exists(self, table: str) -> bool:
        return self._latest(table) is not None

    def _publish(self, table: str, entry: dict, tag: str) -> None:
        """Make a commit visible, unless its number was taken meanwhile."""
        path = f"{self._folder(table)}/_log/{entry['version']:012d}.json"
        try:
            files.publish_text(self.spark, path, json.dumps(entry), tag)
        except files.FileExists:
            self._drop_attempt(table, tag)
            raise CommitConflict(
                f"commit {entry['version']} of table '{table}' was taken by another writer"
            ) from None
        files.write_text(self.spark, f"{self._folder(table)}/_log/_newest", str(entry["version"]))

    def _drop_attempt(self, table: str, tag: str, keep: Collection[str] = ()) -> None:
        """Delete what an attempt to commit has written and no log entry names."""
        for part in files.names(self.spark, self._folder(table)):
            if part.endswith(tag) and part not in keep:
                files.delete(self.spark, f"{self._folder(table)}/{part}")

    def catalog(self) -> DataFrame:
        """One row per table: name, version, last_updated. Read from the newest
        log entry of each table."""
        entries = [(t, self._latest(t)) for t in files.names(self.spark, f"{self.root}/data")]
        rows = [(t, e["version"], e["last_updated"]) for t, e in entries if e]
        return self.spark.createDataFrame(rows, "table string, version long, last_updated string")

    def commit_log(self, table: str) -> DataFrame:
        """One row per commit: version, time, policy, rows written, parts."""
        return self.spark.read.schema(LOG_LAYOUT).json(
            f"{self._folder(table)}/_log/[0-9]*.json"
        )

    def committed_batch(self, table: str, source: str) -> int:
        """The last batch number recorded for a stream, or -1."""
        entry = self._latest(table)
        return (entry or {}).get("batches", {}).get(source, -1)

    # -- reading -------------------------------------------------------------

    def _paths(
        self, table: str, entry: dict, parts: Sequence[str] | None = None, buckets: Sequence[int] | None = None
    ) -> list[str]:
        """Folders that a log entry says to read: parts, or where only some buckets
        of a part count or are wanted, these."""
        out = []
        for part in entry["parts"] if parts is None else parts:
            folder = f"{self._folder(table)}/{part}"
            live = entry.get("live", {}).get(part)
            wanted = live if live is None or buckets is None else [b for b in live if b in set(buckets)]
            if live is None or wanted == live and part not in entry.get("cut", ()):
                out.append(folder)
            else:
                out += [f"{folder}/{_BUCKET}={b}" for b in wanted]
        return out

    def _read_parts(self, table: str, entry: dict, paths: Sequence[str] | None = None, more: str = ""):
        """Read with the layout of the log entry: columns that an older part
        lacks come back null, and no footer is opened to infer. Folders of buckets
        are looked into, but are no column."""
        layout = T.StructType.fromJson(json.loads(entry["layout"]))
        for name in more.split():
            layout = layout.add(name, "string")
        paths = self._paths(table, entry) if paths is None else paths
        if not paths:
            return self.spark.createDataFrame([], layout)
        return self.spark.read.schema(layout).option("recursiveFileLookup", True).parquet(*paths)

    def _stored(self, table: str) -> DataFrame:
        entry = self._latest(table)
        if entry is None:
            raise FileNotFoundError(
                f"table '{table}' does not exist; available: {self.tables()}"
            )
        return self._read_parts(table, entry)

    def history(self, table: str) -> DataFrame:
        """All versions with ``_version``, ``_deleted``, ``_metadata``."""
        self._need_versions()
        return self._stored(table).drop(versions.SEQ)

    def read_table(self, table: str) -> DataFrame:
        """The table; for a versioned store, the latest live rows."""
        if self.backend is Backend.PARQUET_VERSIONED:
            return versions.current_view(self._head(table), self.key(table), self.tombstone)
        return self._stored(table)

    def _head(self, table: str, entry: dict | None = None) -> DataFrame:
        """Rows of a versioned table that can be the newest of their key: those of the
        snapshot and of the parts after it. Without a snapshot, all."""
        entry = entry or self._latest(table)
        if entry is None or not entry.get("snapshot") or not self.key(table):
            return self._stored(table)
        parts = [entry["snapshot"], *entry["after"]]
        return self._read_parts(table, entry, self._paths(table, entry, parts))

    def read_table_column(self, table: str, column: str) -> DataFrame:
        return self.read_table(table).select(named(column))

    def primary_keys(self, table: str) -> DataFrame:
        """Existing key values; no rows when the table has no key or no data."""
        key = self.key(table)
        if key is None:
            return self.spark.createDataFrame([], T.StructType([]))
        if not self.exists(table):
            layout = self.schema(table).struct([key])
            return self.spark.createDataFrame([], layout)
        return self.read_table_column(table, key)

    def read_as_of(self, table: str, moment: str) -> DataFrame:
        """The table as it was at ``moment``. The log tells which parts were there;
        of a compacted part the rows that were valid then are read."""
        self._need_versions()
        entry = self._latest(table)
        if entry is None or len(entry.get("times", {})) < len(entry["parts"]) - bool(entry.get("closed")):
            return versions.as_of(self._stored(table), self.key(table), moment, self.tombstone)
        closed = entry.get("closed")
        parts = [p for p in entry["parts"] if p != closed and entry["times"][p] <= moment]
        rows = self._read_parts(table, entry, self._paths(table, entry, parts))
        if closed:
            old = self._read_parts(table, entry, self._paths(table, entry, [closed]), f"{_FROM} {_TO}")
            valid = F.col(_FROM) <= moment
            if self.tombstone == "hide":  # else a deleted row lets the one before it through
                valid = valid & (F.col(_TO).isNull() | (F.col(_TO) > moment))
            rows = old.filter(valid).drop(_FROM, _TO).unionByName(rows)
        return versions.current_view(rows, self.key(table), self.tombstone)

    def version_history(self, table: str, columns: Sequence[str] | None = None):
        self._need_versions()
        return versions.version_history(self._stored(table), self.key(table), columns)

    def _need_versions(self) -> None:
        if self.backend is not Backend.PARQUET_VERSIONED:
            raise ValueError("only a versioned store keeps history")

    # -- committing ----------------------------------------------------------

    def commit_tables(
        self,
        batches: Mapping[str, DataFrame] | Sequence[tuple[str, DataFrame]] | Sequence[str],
        frames: Sequence[DataFrame | list[dict]] | None = None,
        **options,
    ) -> dict[str, dict | None]:
        """Commit several tables in turn, after checking all of them.

        Takes a mapping, (table, frame) pairs, or parallel lists of names and
        frames (records are accepted as frames). A table named several times gets
        each of its frames, in order. Tables commit one by one, not atomically
        together. Returns the last log entry of each table.
        """
        if frames is not None:
            if len(batches) != len(frames):
                raise ValueError(
                    f"{len(batches)} table names but {len(frames)} datasets"
                )
            batches = list(zip(batches, frames, strict=True))
        pairs = batches.items() if isinstance(batches, Mapping) else batches
        ready = []
        for table, frame in pairs:
            if not isinstance(frame, DataFrame):
                if not frame:
                    continue
                frame = _from_records(self.spark, frame, self.schema(table))
            self._check_key(table, frame)
            ready.append((table, frame))
        done: dict[str, dict | None] = {}
        for table, frame in ready:
            done[table] = self.commit_table(table, frame, **options) or done.get(table)
        return done

    def _check_key(self, table: str, batch: DataFrame) -> list[str]:
        keys = key_list(self.key(table))
        for k in keys:
            if k not in batch.columns:
                raise ValueError(f"primary key '{k}' is not among the batch's columns")
        return keys

    def commit_table(
        self,
        table: str,
        batch: DataFrame,
        policy: WritePolicy | None = None,
        backup: BackupPolicy | None = None,
        commit_time: str | None = None,
        order_by: str | None = None,
        on_error: str = "fail",
        source: str | None = None,
        batch_id: int | None = None,
        backup_when: str = "after",
        retries: int = 2,
    ) -> dict | None:
        """Merge a batch into a table; returns the log entry, None for a no-op.

        ``order_by`` names a column giving row order inside the batch (it is
        not stored); repeats of a key are settled by it. ``source`` and
        ``batch_id`` make a repeated delivery a no-op. When another writer
        commits first, the batch is merged again, into what is there now, up to
        ``retries`` times.
        """
        for attempt in range(retries + 1):
            try:
                return self._commit(
                    table, batch, policy, backup, commit_time, order_by, on_error, source, batch_id, backup_when
                )
            except CommitConflict:
                if attempt == retries:
                    raise

    def _commit(
        self, table, batch, policy, backup, commit_time, order_by, on_error, source, batch_id, backup_when
    ) -> dict | None:
        policy = self.write_policy if policy is None else policy
        backup = self.backup_policy if backup is None else backup
        if not isinstance(policy, WritePolicy):
            raise ValueError(f"not a write policy: {policy!r}")
        if not isinstance(backup, BackupPolicy):
            raise ValueError(f"not a backup policy: {backup!r}")
        if backup_when not in ("before", "after"):
            raise ValueError(f"unknown backup_when {backup_when!r}")
        keys = self._check_key(table, batch)
        entry = self._latest(table)
        if source is not None and (entry or {}).get("batches", {}).get(source, -1) >= batch_id:
            return None
        commit_time = commit_time or datetime.now().isoformat(timespec="seconds")
        number = (entry["version"] if entry else 0) + 1
        tag = uuid.uuid4().hex[:12]

        layout, prepared = self._prepare(table, batch, keys, entry, order_by, on_error, policy)
        merged = self._merge(
            table, prepared, layout, keys, entry, policy, commit_time, number, tag
        )
        if merged is None:
            self._drop_attempt(table, tag)
        if merged is None and (source is None or entry is None):
            return None
        parts, rows, layout, *laid = merged or (entry["parts"], 0, layout)
        if (
            backup is BackupPolicy.TIMESTAMPED_COPIES
            and backup_when == "before"
            and entry is not None
        ):
            self._copy(table, entry, commit_time)
        batches = dict((entry or {}).get("batches", {}))
        if source is not None:
            batches[source] = batch_id
        new_entry = {
            "format": FORMAT,
            "version": number,
            "last_updated": commit_time,
            "backend": self.backend.value,
            "policy": policy.value,
            "parts": parts,
            "layout": layout.json(),
            "rows": rows,
            "batches": batches,
            **{k: entry[k] for k in ("buckets", "live", "cut", "snapshot", "closed") if entry and k in entry},
            **(laid[0] if laid else {}),
        }
        self._note_parts(new_entry, entry)
        self._publish(table, new_entry, tag)
        self._drop_attempt(table, tag, parts)  # the batch, if its rows went into other parts
        if backup is BackupPolicy.TIMESTAMPED_COPIES and backup_when == "after":
            self._copy(table, new_entry, commit_time)
        if len(new_entry.get("after", ())) >= self.snapshot_every:
            try:
                self.snapshot(table)
            except CommitConflict:  # the next commit makes it
                pass
        return new_entry

    def _note_parts(self, new_entry: dict, entry: dict | None) -> None:
        """When the parts of a versioned table were committed, and which came after its
        snapshot. A part's rows share one commit."""
        if self.backend is not Backend.PARQUET_VERSIONED:
            return
        times = (entry or {}).get("times", {})
        old = set((entry or {}).get("parts", ()))
        came = [p for p in new_entry["parts"] if p not in old]
        new_entry["times"] = {p: times[p] for p in new_entry["parts"] if p in times}
        new_entry["times"] |= {p: new_entry["last_updated"] for p in came}
        new_entry["after"] = [*(entry or {}).get("after", ()), *came]

    def _prepare(self, table, batch, keys, entry, order_by, on_error, policy):
        """Cast and pad the batch; returns the table's layout and the batch."""
        schema = self.schema(table)
        # Row order is fixed before anything else can move rows.
        seq = named(order_by) if order_by else F.monotonically_increasing_id()
        if order_by:
            rest = [named(c) for c in batch.columns if c != order_by]
        else:
            rest = [named(c) for c in batch.columns]
        ordered = nan_to_null(batch.select(*rest, seq.cast("long").alias(versions.SEQ)))
        data = ordered.drop(versions.SEQ)
        # A supplied-columns merge must not pad what was not supplied.
        partial = (
            self.backend is Backend.SQL
            and entry is not None
            and policy is WritePolicy.UPSERT
        )
        if schema is not None and schema.columns:
            extra = [c for c in data.columns if c not in schema.columns]
            keep = schema.columns + (extra if self.extra == "keep" else [])
            full = conform(ordered, schema, on_error, "keep")
            if partial:
                keep = [c for c in keep if c in data.columns]
            data_names = keep
        else:
            full = ordered
            data_names = data.columns
        full = full.select(*[named(c) for c in data_names], F.col(versions.SEQ))
        if entry is None:
            return T.StructType([f for f in full.schema.fields if f.name != versions.SEQ]), full
        old = T.StructType.fromJson(json.loads(entry["layout"]))
        old_names = set(old.fieldNames())
        full = cast_to(
            full, T.StructType([f for f in old.fields if f.name in data_names]), on_error
        )
        added = [
            f
            for f in full.schema.fields
            if f.name not in old_names and f.name != versions.SEQ
        ]
        return T.StructType([*old.fields, *added]), full

    def _write(self, df: DataFrame, table: str, number: int, kind: str, tag: str, buckets: Column | None = None, n: int = 1):
        """Write a part; with ``buckets`` into a folder for each of ``n`` of them."""
        part = f"part-{number:012d}-{kind}-{tag}"
        path = f"{self._folder(table)}/{part}"
        if n > 1:
            bucketed = df.withColumn(_BUCKET, buckets).repartition(n, _BUCKET)
            bucketed.write.partitionBy(_BUCKET).parquet(path)
        else:
            df.write.parquet(path)
        return part

    def _buckets_of(self, table: str, part: str) -> list[int]:
        """The buckets that a part has rows in."""
        names = files.names(self.spark, f"{self._folder(table)}/{part}")
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith(_BUCKET + "="))

    def _rows(self, table: str, parts: Sequence[str], layout: T.StructType) -> int:
        """Row count from Parquet footers."""
        paths = [f"{self._folder(table)}/{p}" for p in parts]
        return self.spark.read.schema(layout).option("recursiveFileLookup", True).parquet(*paths).count()

    def _merge(self, table, batch, layout, keys, entry, policy, commit_time, number, tag):
        """Write what the commit adds; returns (parts, rows added, layout)."""
        versioned = self.backend is Backend.PARQUET_VERSIONED
        if self.backend is Backend.SQL and keys:
            # A SQL store applies rows in order: inside one batch an append
            # keeps the first of repeated keys and an upsert the last.
            keep = "first" if policy is WritePolicy.APPEND else "last"
            batch = merge.one_per_key(batch, keys, versions.SEQ, keep)
        elif not versioned:
            batch = batch.drop(versions.SEQ)

        if entry is None:
            if versioned:
                batch = versions.first_versions(batch, commit_time)
                layout = batch.schema
            part = self._write(batch, table, number, "new", tag)
            rows = self._rows(table, [part], layout)
            return ([part], rows, layout) if rows else None

        if not keys:
            if versioned:
                batch = versions.first_versions(batch, commit_time)
            part = self._write(batch, table, number, "new", tag)
            rows = self._rows(table, [part], batch.schema)
            return ([*entry["parts"], part], rows, layout) if rows else None

        staged = self._write(batch, table, number, "batch", tag)
        n_batch = self._rows(table, [staged], batch.schema)
        if n_batch == 0:
            return None
        batch = self.spark.read.schema(batch.schema).parquet(
            f"{self._folder(table)}/{staged}"
        )
        if versioned:
            rule = (
                versions.append_versions
                if policy is WritePolicy.APPEND
                else versions.upsert_versions
            )
            added = rule(self._head(table, entry), batch, keys, commit_time)
            return self._add_rows(table, added, layout, entry, number, tag)
        return self._merge_buckets(table, batch, n_batch, layout, keys, entry, policy, number, tag)

    def _add_rows(self, table, added, layout, entry, number, tag):
        part = self._write(added, table, number, "new", tag)
        rows = self._rows(table, [part], added.schema)
        return ([*entry["parts"], part], rows, layout) if rows else None

    def _wanted_buckets(self, table: str, entry: dict) -> int:
        """Buckets for a table of this size. They change when those it has have grown
        fourfold, and never get fewer."""
        size = sum(files.size(self.spark, p) for p in self._paths(table, entry))
        wanted, now = -(-size // self.bucket_bytes), entry.get("buckets", 1)
        return wanted if wanted > (4 * now if now > 1 else 1) else now

    def _merge_buckets(self, table, batch, n_batch, layout, keys, entry, policy, number, tag):
        """Merge a batch into the buckets that its keys fall into.

        A table without buckets is one bucket. When the number of buckets changes,
        an upsert rewrites the whole table; at most one row a bucket is collected."""
        sql, append = self.backend is Backend.SQL, policy is WritePolicy.APPEND
        now = entry.get("buckets", 1)
        n = now if append else self._wanted_buckets(table, entry)
        bucket = F.pmod(F.hash(*[named(k) for k in keys]), F.lit(n))
        touched = None
        if n > 1 and n == now:
            touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())
        target = self._read_parts(table, entry, self._paths(table, entry, buckets=touched))
        if append:
            added = merge.unseen(batch, target, keys, null_safe=not sql)
            part = self._write(added, table, number, "new", tag, bucket, n)
            rows = self._rows(table, [part], added.schema)
            if not rows:
                return None
            live = {**entry.get("live", {}), part: self._buckets_of(table, part)} if n > 1 else {}
            return [*entry["parts"], part], rows, layout, {"live": live}
        if sql:
            rest = merge.overlay_columns(target, batch, keys)
            fresh = merge.unseen(batch, target, keys, null_safe=False)
        else:
            rest, fresh = merge.without_keys(target, batch, keys), batch
        whole = rest.unionByName(fresh, allowMissingColumns=True)
        part = self._write(whole, table, number, "merged", tag, bucket, n)
        if touched is None:
            live = {part: self._buckets_of(table, part)} if n > 1 else {}
            return [part], n_batch, layout, {"buckets": n, "live": live, "cut": []}
        live, cut = {}, set(entry.get("cut", ()))
        for old, held in entry["live"].items():
            left = [b for b in held if b not in set(touched)]
            if left:
                live[old] = left
            if left and left != held:
                cut.add(old)
        live[part] = self._buckets_of(table, part)
        parts = [p for p in [*entry["parts"], part] if p in live]
        return parts, n_batch, layout, {"live": live, "cut": [p for p in parts if p in cut]}

    def delete_keys(
        self, table: str, doomed: DataFrame, commit_time: str | None = None
    ) -> dict | None:
        """Append a deleting version for each given key that is live."""
        self._need_versions()
        entry = self._latest(table)
        if entry is None:
            raise FileNotFoundError(f"table '{table}' does not exist")
        keys = self._check_key(table, doomed)
        if not keys:
            raise ValueError(f"table '{table}' has no key to delete by")
        commit_time = commit_time or datetime.now().isoformat(timespec="seconds")
        number, tag = entry["version"] + 1, uuid.uuid4().hex[:12]
        layout = T.StructType.fromJson(json.loads(entry["layout"]))
        rows = versions.tombstones(self._head(table, entry), doomed, keys, commit_time)
        added = self._add_rows(table, rows, layout, entry, number, tag)
        if added is None:
            return None
        new_entry = {
            **entry,
            "version": number,
            "last_updated": commit_time,
            "policy": "delete",
            "parts": added[0],
            "rows": added[1],
        }
        self._note_parts(new_entry, entry)
        self._publish(table, new_entry, tag)
        return new_entry

    # -- backups and housekeeping ---------------------------------------------

    def _copy(self, table: str, entry: dict, commit_time: str) -> str:
        stamp = commit_time.replace(":", "-")
        path = f"{self.root}/backup/{table}/{stamp}_{entry['version']:06d}"
        self._read_parts(table, entry).write.parquet(path)
        return path

    def backups(self, table: str) -> list[str]:
        folder = f"{self.root}/backup/{table}"
        return [f"{folder}/{n}" for n in files.names(self.spark, folder)]

    def snapshot(self, table: str) -> dict | None:
        """Write the newest row of each key of a versioned table aside, and the newest
        live one where that is another. Made from the snapshot before it and the parts
        since. None when the table has no key or nothing new."""
        self._need_versions()
        entry, keys = self._latest(table), key_list(self.key(table))
        if entry is None or not keys or (entry.get("snapshot") and not entry["after"]):
            return None
        number, tag = entry["version"] + 1, uuid.uuid4().hex[:12]
        rows = versions.newest(self._head(table, entry), keys)
        part = self._write(rows, table, number, "snapshot", tag)
        new_entry = {**entry, "version": number, "policy": "snapshot", "rows": 0, "snapshot": part, "after": []}
        self._publish(table, new_entry, tag)
        return new_entry

    def compact(self, table: str) -> dict | None:
        """Rewrite many small parts, as left by a stream, into one. A keyed table gets
        as many buckets as it needs; rows of a versioned table get the interval in
        which they were valid, and a snapshot is made."""
        entry = self._latest(table)
        if entry is None or len(self._paths(table, entry)) < 2:
            return None
        keys, n, changes = key_list(self.key(table)), 1, {}
        number, tag = entry["version"] + 1, uuid.uuid4().hex[:12]
        rows, bucket = self._read_parts(table, entry), None
        if self.backend is Backend.PARQUET_VERSIONED:
            if keys and len(entry.get("times", {})) == len(entry["parts"]) - bool(entry.get("closed")):
                rows = versions.closed(self._dated(table, entry), keys, _FROM, _TO)
                changes["closed"] = f"part-{number:012d}-compact-{tag}"
        elif keys:
            n = self._wanted_buckets(table, entry)
            bucket = F.pmod(F.hash(*[named(k) for k in keys]), F.lit(n))
        part = self._write(rows, table, number, "compact", tag, bucket, n)
        live = {part: self._buckets_of(table, part)} if n > 1 else {}
        new_entry = {
            **entry,
            "version": number,
            "policy": "compact",
            "parts": [part],
            "rows": 0,
            **({"buckets": n, "live": live, "cut": []} if bucket is not None else {}),
            **changes,
        }
        if changes:
            new_entry |= {"times": {}, "snapshot": entry.get("snapshot"), "after": []}
            newest = versions.newest(self._head(table, entry), keys)
            new_entry["snapshot"] = self._write(newest, table, number, "snapshot", tag)
        self._publish(table, new_entry, tag)
        return new_entry

    def _dated(self, table: str, entry: dict) -> DataFrame:
        """All versions with the time of their commit: by row in a compacted part, by
        the log for every other."""
        closed = entry.get("closed")
        later = [p for p in entry["parts"] if p != closed]
        times = self.spark.createDataFrame([(p, entry["times"][p]) for p in later], "__part string, __time string")
        rows = self._read_parts(table, entry, self._paths(table, entry, later))
        part = F.regexp_extract(F.input_file_name(), r"/(part-[^/]+)/[^/]+$", 1)
        dated = rows.withColumn("__in", part).join(times, F.col("__in") == F.col("__part"))
        dated = dated.withColumn(_FROM, F.col("__time")).drop("__in", "__part", "__time")
        if closed:
            old = self._read_parts(table, entry, self._paths(table, entry, [closed]), _FROM)
            dated = old.unionByName(dated)
        return dated

    def drop_unused_parts(self, table: str) -> list[str]:
        """Delete part folders the newest commit no longer names.

        For quiet tables only: readers and writers still using older parts
        would lose them.
        """
        entry = self._latest(table)
        used = {*entry["parts"], entry.get("snapshot")} if entry else set()
        folder = self._folder(table)
        unused = [
            n
            for n in files.names(self.spark, folder)
            if n.startswith("part-") and n not in used
        ]
        for name in unused:
            files.delete(self.spark, f"{folder}/{name}")
        return unused
