import json
import random

import pytest
from conftest import rows

from millrace import Backend, BackupPolicy, TableStore, WritePolicy
from millrace.operators.versions import as_of
from millrace.sources import files
from millrace.sources.store import CommitConflict

TABLE = {
    "type": "object",
    "properties": {
        "site": {"type": "integer", "PrimaryKey": True},
        "beds": {"type": "integer"},
    },
}
NO_KEY = {"properties": {"site": {"type": "integer"}, "beds": {"type": "integer"}}}
BASE = [(1, 40), (2, 55), (3, 62)]
BATCH = [(1, 71), (3, 18), (4, 90), (5, 33)]
T1, T2 = "2023-05-11T08:00:00", "2023-06-30T17:45:10"


def frame(spark, data, names="site long, beds long"):
    return spark.createDataFrame(data, names)


@pytest.fixture
def make(spark, tmp_path):
    def build(backend=Backend.PARQUET, schema=TABLE, **options):
        store = TableStore(spark, str(tmp_path), backend, **options)
        if schema:
            store.put_schema("clinics", schema)
        return store

    return build


@pytest.fixture(params=[Backend.PARQUET, Backend.PARQUET_VERSIONED, Backend.SQL])
def any_store(request, make):
    return make(request.param)


def test_new_table_reads_back(any_store, spark):
    entry = any_store.commit_table("clinics", frame(spark, BASE))
    assert entry["rows"] == 3
    assert any_store.tables() == ["clinics"]
    assert rows(any_store.read_table("clinics")) == BASE
    assert any_store.read_table("clinics").columns == ["site", "beds"]
    assert rows(any_store.read_table_column("clinics", "beds")) == [(40,), (55,), (62,)]
    assert rows(any_store.primary_keys("clinics")) == [(1,), (2,), (3,)]


def test_upsert_replaces_rows(any_store, spark):
    any_store.commit_table("clinics", frame(spark, BASE))
    any_store.commit_table("clinics", frame(spark, BATCH))
    assert rows(any_store.read_table("clinics")) == [(1, 71), (2, 55), (3, 18), (4, 90), (5, 33)]


def test_append_keeps_old_rows(any_store, spark):
    any_store.set_write_policy(WritePolicy.APPEND)
    any_store.commit_table("clinics", frame(spark, BASE))
    any_store.commit_table("clinics", frame(spark, BATCH))
    assert rows(any_store.read_table("clinics")) == [(1, 40), (2, 55), (3, 62), (4, 90), (5, 33)]


@pytest.mark.parametrize("policy", list(WritePolicy))
@pytest.mark.parametrize("backend", [Backend.PARQUET, Backend.SQL])
def test_without_key_everything_is_added(make, spark, policy, backend):
    store = make(backend, NO_KEY)
    store.commit_table("clinics", frame(spark, BASE), policy)
    store.commit_table("clinics", frame(spark, BASE), policy)
    assert rows(store.read_table("clinics")) == sorted(BASE * 2)
    assert store.primary_keys("clinics").columns == []


def test_first_write_keeps_repeats_of_a_key(make, spark):
    store = make()
    store.commit_table("clinics", frame(spark, [(1, 1), (1, 2)]))
    assert rows(store.read_table("clinics")) == [(1, 1), (1, 2)]


def test_append_keeps_repeats_inside_the_batch(make, spark):
    store = make(write_policy=WritePolicy.APPEND)
    store.commit_table("clinics", frame(spark, BASE))
    store.commit_table("clinics", frame(spark, [(1, 90), (7, 1), (7, 2)]))
    assert rows(store.read_table("clinics")) == [*BASE, (7, 1), (7, 2)]


@pytest.mark.parametrize(
    ("policy", "expected"),
    [
        (WritePolicy.UPSERT, [(1, 40), (None, 2)]),
        (WritePolicy.APPEND, [(1, 40), (None, 1)]),
    ],
)
def test_missing_keys_match_each_other(make, spark, policy, expected):
    store = make(write_policy=policy)
    store.commit_table("clinics", frame(spark, [(1, 40), (None, 1)]))
    store.commit_table("clinics", frame(spark, [(None, 2)]))
    assert rows(store.read_table("clinics")) == sorted(expected, key=repr)


def test_columns_missing_from_a_batch_become_null(make, spark):
    store = make()
    store.commit_table("clinics", frame(spark, BASE))
    store.commit_table("clinics", frame(spark, [(1,)], "site long"))
    assert rows(store.read_table("clinics")) == sorted([(1, None), (2, 55), (3, 62)], key=repr)


def test_extra_columns(make, spark):
    extra = frame(spark, [(9, 90, "x")], "site long, beds long, more string")
    store = make()
    store.commit_table("clinics", extra)
    assert store.read_table("clinics").columns == ["site", "beds"]
    keeping = make(extra="keep")
    keeping.commit_table("clinics", extra)
    assert rows(keeping.read_table("clinics")) == [(9, 90, "x")]


def test_extra_columns_join_later(make, spark):
    store = make(extra="keep")
    store.commit_table("clinics", frame(spark, BASE))
    store.commit_table("clinics", frame(spark, [(3, 1, "x")], "site long, beds long, more string"))
    assert rows(store.read_table("clinics")) == sorted(
        [(1, 40, None), (2, 55, None), (3, 1, "x")], key=repr
    )


def test_values_that_do_not_fit(make, spark):
    store = make()
    bad = frame(spark, [("1", "x")], "site string, beds string")
    with pytest.raises(Exception, match="beds"):
        store.commit_table("clinics", bad)
    assert store.tables() == []
    store.commit_table("clinics", bad, on_error="null")
    assert rows(store.read_table("clinics")) == [(1, None)]
    with pytest.raises(Exception, match="beds"):
        store.commit_table("clinics", frame(spark, [(1, 1.5)], "site long, beds double"))


def test_without_schema_the_batch_keeps_its_columns(make, spark):
    store = make(schema=None)
    store.commit_table("clinics", frame(spark, BASE))
    store.commit_table("clinics", frame(spark, BASE))
    assert rows(store.read_table("clinics")) == sorted(BASE * 2)


def test_empty_batch_changes_nothing(any_store, spark):
    assert any_store.commit_table("clinics", frame(spark, [])) is None
    assert any_store.tables() == []
    any_store.commit_table("clinics", frame(spark, BASE))
    assert any_store.commit_table("clinics", frame(spark, [])) is None
    assert any_store.commit_log("clinics").count() == 1


def test_key_has_to_be_present(any_store, spark):
    with pytest.raises(ValueError, match="primary key"):
        any_store.commit_table("clinics", frame(spark, [(1,)], "beds long"))


def test_two_keys_are_refused(make):
    spec = {"type": "integer", "PrimaryKey": True}
    store = make(schema={"properties": {"a": spec, "b": spec}})
    with pytest.raises(ValueError, match="more than one"):
        store.key("clinics")


def test_policies_are_checked(make, spark):
    store = make()
    assert store.write_policy is WritePolicy.UPSERT
    assert store.backup_policy is BackupPolicy.NONE
    for call in (store.set_write_policy, store.set_backup_policy):
        with pytest.raises(ValueError):
            call("upsert")
    with pytest.raises(ValueError):
        store.commit_table("clinics", frame(spark, BASE), policy="other")
    with pytest.raises(ValueError):
        store.commit_table("clinics", frame(spark, BASE), backup="other")


def test_several_tables(make, spark):
    store = make()
    store.put_schema("table2", TABLE)
    store.commit_tables(["clinics", "table2"], [frame(spark, BASE), frame(spark, BATCH)])
    assert store.tables() == ["clinics", "table2"]
    store.commit_tables(
        ["clinics", "table2"], [[{"beds": 1, "site": 1}], [{"site": 1, "beds": 2}]]
    )
    assert (1, 1) in rows(store.read_table("clinics"))
    assert (1, 2) in rows(store.read_table("table2"))
    with pytest.raises(ValueError, match="2 table names"):
        store.commit_tables(["clinics", "table2"], [frame(spark, BASE)])


def test_nothing_is_written_when_one_batch_lacks_its_key(make, spark):
    store = make()
    store.put_schema("table2", TABLE)
    with pytest.raises(ValueError):
        store.commit_tables(
            {"clinics": frame(spark, BASE), "table2": frame(spark, [(1,)], "beds long")}
        )
    assert store.tables() == []


def test_sql_rules_inside_a_batch(make, spark):
    names = "site long, beds long, ord long"
    store = make(Backend.SQL)
    store.commit_table("clinics", frame(spark, BASE))
    store.commit_table(
        "clinics",
        frame(spark, [(1, 0, 1), (7, 1, 1), (7, 2, 2)], names),
        WritePolicy.APPEND,
        order_by="ord",
    )
    assert rows(store.read_table("clinics")) == [*BASE, (7, 1)]
    store.commit_table(
        "clinics", frame(spark, [(7, 55, 2), (7, 40, 1), (8, 1, 1)], names), order_by="ord"
    )
    assert rows(store.read_table("clinics")) == [*BASE, (7, 55), (8, 1)]


def test_sql_upsert_leaves_other_columns(make, spark):
    store = make(Backend.SQL)
    store.commit_table("clinics", frame(spark, BASE))
    store.commit_table("clinics", frame(spark, [(1,), (9,)], "site long"))
    assert rows(store.read_table("clinics")) == sorted([*BASE, (9, None)], key=repr)


@pytest.mark.parametrize("backend", [Backend.PARQUET, Backend.SQL])
def test_commits_touch_only_buckets_of_their_keys(make, spark, backend):
    store = make(backend, bucket_bytes=300)
    base = spark.range(100, numPartitions=4).selectExpr("id AS site", "id AS beds")
    store.commit_table("clinics", base)
    want = {i: i for i in range(100)}
    first = store.commit_table("clinics", frame(spark, [(0, -1)]))  # too large for one bucket now
    want[0] = -1
    n = first["buckets"]
    assert n > 2 and sorted(first["live"][first["parts"][0]]) == list(range(n))
    for round_no, keys in enumerate([[3, 200], [4, 80, 200], [99]]):
        batch = [(k, -k - round_no) for k in keys]
        entry = store.commit_table("clinics", frame(spark, batch))
        want.update(batch)
        touched = {r[0] for r in frame(spark, batch).selectExpr(f"pmod(hash(site), {n})").collect()}
        new = entry["parts"][-1]
        assert set(entry["live"][new]) == touched and len(touched) < n
        assert all(not touched & set(b) for p, b in entry["live"].items() if p != new)
        assert rows(store.read_table("clinics")) == sorted(want.items(), key=repr)
    assert first["parts"][0] in entry["parts"] and entry["cut"][0] == first["parts"][0]
    appended = store.commit_table("clinics", frame(spark, [(3, 7), (300, 7), (301, 7)]), WritePolicy.APPEND)
    want.update({300: 7, 301: 7})
    assert appended["rows"] == 2 and rows(store.read_table("clinics")) == sorted(want.items(), key=repr)
    store.drop_unused_parts("clinics")
    everything = spark.createDataFrame([(k, 1) for k in want], "site long, beds long")
    assert len(store.commit_table("clinics", everything)["parts"]) == 1
    assert rows(store.read_table("clinics")) == sorted(((k, 1) for k in want), key=repr)
    store.commit_table("clinics", frame(spark, [(5, 5)]))
    compacted = store.compact("clinics")
    assert len(compacted["parts"]) == 1 and compacted["cut"] == []
    assert rows(store.read_table("clinics")) == sorted(((k, 5 if k == 5 else 1) for k in want), key=repr)


def test_missing_and_repeated_keys_in_buckets(make, spark):
    store = make(bucket_bytes=200)
    store.commit_table("clinics", spark.range(60).selectExpr("id AS site", "id AS beds").union(frame(spark, [(None, 1)])))
    store.commit_table("clinics", frame(spark, [(None, 2), (7, 70), (7, 71)]))
    assert store.commit_table("clinics", frame(spark, [(None, 3)]))["buckets"] > 1
    got = rows(store.read_table("clinics"))
    assert [r for r in got if r[0] in (None, 7)] == [(7, 70), (7, 71), (None, 3)] and len(got) == 62
    store.commit_table("clinics", frame(spark, [(7, 1), (None, 9)]), WritePolicy.APPEND)
    assert rows(store.read_table("clinics")) == got


def test_a_log_entry_is_as_long_for_many_files_as_for_few(make, spark):
    sizes = {}
    for n_files in (2, 40):
        store = make(bucket_bytes=1500)
        store.root += f"/{n_files}"
        store.put_schema("clinics", TABLE)
        store.commit_table("clinics", spark.range(0, 4000, 1, n_files).selectExpr("id AS site", "id % 9 AS beds"))
        store.bucket_bytes = files.size(spark, f"{store.root}/data/clinics") // 5
        for k in range(3):
            entry = store.commit_table("clinics", frame(spark, [(k, -1)]))
        sizes[n_files] = len(str({k: v for k, v in entry.items() if k != "live"})), entry["buckets"]
        assert sum(map(len, entry["live"].values())) <= entry["buckets"]
    assert sizes[2][0] == sizes[40][0]


def test_the_newest_entry_is_found_without_listing_the_log(make, spark, monkeypatch):
    store = make()
    entry = store.commit_table("clinics", frame(spark, BASE))
    log = f"{store.root}/data/clinics/_log"
    for version in range(2, 10_001):  # as ten thousand commits would leave it
        with open(f"{log}/{version:012d}.json", "w") as out:
            out.write(json.dumps({**entry, "version": version}))
    files.write_text(spark, f"{log}/_newest", "9998")
    real, reads = files.read_text, []
    monkeypatch.setattr(files, "read_text", lambda s, path: reads.append(path) or real(s, path))
    names = files.names
    monkeypatch.setattr(files, "names", lambda s, path: 1 / 0 if path.endswith("_log") else names(s, path))
    assert store.commit_table("clinics", frame(spark, BATCH))["version"] == 10_001
    assert len([r for r in reads if "/_log/" in r]) <= 4
    monkeypatch.setattr(files, "names", names)
    files.write_text(spark, f"{log}/_newest", "")  # being written
    assert store._latest("clinics")["version"] == 10_001


def test_a_refused_attempt_leaves_no_parts(make, spark, monkeypatch):
    store = make()
    store.commit_table("clinics", frame(spark, BASE))
    real, stale = store._latest, store._latest("clinics")
    seen = iter([stale])
    other = make()
    other.commit_table("clinics", frame(spark, [(8, 8)]))
    monkeypatch.setattr(store, "_latest", lambda t: next(seen, None) or real(t))
    store.commit_table("clinics", frame(spark, BATCH))
    assert rows(store.read_table("clinics")) == [(1, 71), (2, 55), (3, 18), (4, 90), (5, 33), (8, 8)]
    kept = [n for n in files.names(spark, f"{store.root}/data/clinics") if n.startswith("part-")]
    assert len(kept) == 3  # one a commit


def history_of(store, spark, days=8):
    """Inserts, changes, deletions and returns, a commit a day."""
    rng = random.Random(5)
    for day in range(days):
        when = f"2024-01-{day + 1:02d}T00:00:00"
        if day and day % 3 == 0:
            store.delete_keys("clinics", frame(spark, [(k, 0) for k in rng.sample(range(12), 4)]), when)
        else:
            batch = [(rng.randrange(12), rng.randrange(4)) for _ in range(6)] + [(None, 9)] * (day == 0)
            store.commit_table("clinics", frame(spark, batch), commit_time=when)


def parts_read(df):
    return {f.split("/part-")[1].split("/")[0] for f in df.inputFiles()}


@pytest.mark.parametrize("tombstone", ["hide", "skip"])
def test_current_view_reads_the_snapshot_and_later_parts(make, spark, tombstone):
    store = make(Backend.PARQUET_VERSIONED, tombstone=tombstone, snapshot_every=3)
    plain = make(Backend.PARQUET_VERSIONED, tombstone=tombstone, snapshot_every=10**6)
    plain.root += "/plain"
    plain.put_schema("clinics", TABLE)
    for s in (store, plain):
        history_of(s, spark)
    entry = store._latest("clinics")
    assert entry["snapshot"] and len(entry["after"]) < 3 and "snapshot" not in plain._latest("clinics")
    # the same rows and versions, whether commits looked at the snapshot or at all history
    assert rows(store.history("clinics")) == rows(plain.history("clinics"))
    current = store.read_table("clinics")
    assert rows(current) == rows(plain.read_table("clinics"))
    read = parts_read(current)
    assert read == {p[5:] for p in [entry["snapshot"], *entry["after"]]} and len(read) < len(entry["parts"])
    store.drop_unused_parts("clinics")
    assert rows(store.read_table("clinics")) == rows(plain.read_table("clinics"))
    assert store.snapshot("clinics")["after"] == [] and store.snapshot("clinics") is None
    assert rows(store.read_table("clinics")) == rows(plain.read_table("clinics"))


@pytest.mark.parametrize("tombstone", ["hide", "skip"])
def test_as_of_reads_only_parts_up_to_the_moment(make, spark, tombstone):
    store = make(Backend.PARQUET_VERSIONED, tombstone=tombstone, snapshot_every=4)
    history_of(store, spark, 5)
    moments = [f"2024-01-{d:02d}T00:00:00" for d in range(1, 10)] + ["2023-01-01", "2024-01-03T12:00:00"]

    def check():
        whole = store._stored("clinics")
        for moment in moments:
            got = store.read_as_of("clinics", moment)
            assert rows(got) == rows(as_of(whole, "site", moment, tombstone))
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "get_json_object" not in plan

    check()
    first = store.read_as_of("clinics", "2024-01-02T00:00:00")
    assert len(parts_read(first)) == 2
    before = rows(store.history("clinics"))
    compacted = store.compact("clinics")
    assert len(compacted["parts"]) == 1 and rows(store.history("clinics")) == before
    check()
    for day in (6, 7):
        store.commit_table("clinics", frame(spark, [(1, day), (2, 0)]), commit_time=f"2024-01-{day:02d}T00:00:00")
    check()
    assert parts_read(store.read_as_of("clinics", moments[5])) == {p[5:] for p in [compacted["parts"][0], store._latest("clinics")["parts"][1]]}
    store.compact("clinics")  # intervals that were open are closed
    store.drop_unused_parts("clinics")
    check()
    assert rows(store.read_table("clinics")) == rows(store.read_as_of("clinics", "2025"))


def test_typed_storage(make, spark):
    schema = {
        "properties": {
            "k": {"type": "integer", "PrimaryKey": True},
            "d": {"type": "string", "format": "date"},
            "t": {"type": "string", "format": "date-time"},
            "a": {"type": ["array", "null"]},
        }
    }
    store = make(schema=schema, storage="typed")
    batch = spark.createDataFrame(
        [("1", "2024-01-02", "2024-01-02 03:04:05", "[x, 'y']"), ("2", None, None, None)],
        "k string, d string, t string, a string",
    )
    store.commit_table("clinics", batch)
    out = store.read_table("clinics")
    assert [t for _, t in out.dtypes] == ["bigint", "date", "timestamp_ntz", "array<string>"]
    first = out.filter("k = 1").first()
    assert (str(first.d), str(first.t), first.a) == ("2024-01-02", "2024-01-02 03:04:05", ["x", "y"])
    with pytest.raises(Exception, match="column 'a'"):
        store.commit_table("clinics", batch.withColumn("a", batch.k))


def test_keyless_tables_have_no_version_history(make, spark):
    store = make(Backend.PARQUET_VERSIONED, NO_KEY)
    store.commit_table("clinics", frame(spark, BASE))
    with pytest.raises(ValueError, match="key"):
        store.version_history("clinics")
    with pytest.raises(ValueError, match="key"):
        store.delete_keys("clinics", frame(spark, BASE))


@pytest.mark.parametrize("when", ["before", "after"])
def test_backups(make, spark, when):
    store = make(backup_policy=BackupPolicy.TIMESTAMPED_COPIES)
    store.commit_table("clinics", frame(spark, BASE), backup_when=when, commit_time=T1)
    store.commit_table("clinics", frame(spark, [(1, 90)]), backup_when=when, commit_time=T2)
    copies = [rows(spark.read.parquet(p)) for p in store.backups("clinics")]
    after = [(1, 90), (2, 55), (3, 62)]
    assert copies == ([BASE] if when == "before" else [BASE, after])


def test_log(make, spark):
    store = make()
    store.commit_table("clinics", frame(spark, BASE), commit_time=T1)
    store.commit_table("clinics", frame(spark, BATCH), WritePolicy.APPEND, commit_time=T2)
    assert rows(store.commit_log("clinics"), "version", "last_updated", "policy", "rows") == [
        (1, T1, "upsert", 3),
        (2, T2, "append", 2),
    ]


def test_racing_writers(make, spark):
    store = make()
    store.commit_table("clinics", frame(spark, BASE))
    entry = f"{store.root}/data/clinics/_log/{2:012d}.json"
    original = store._merge

    def slow(*args):
        merged = original(*args)
        theirs = json.loads(files.read_text(spark, entry.replace("2.json", "1.json"))) | {"version": 2}
        files.write_text(spark, entry, json.dumps(theirs))
        return merged

    store._merge = slow
    with pytest.raises(CommitConflict):
        store.commit_table("clinics", frame(spark, BATCH), retries=0)
    assert rows(store.read_table("clinics")) == BASE
    # the other writer holds number 2 now; a retry merges into what it left
    files.delete(spark, entry)
    assert store.commit_table("clinics", frame(spark, BATCH))["version"] == 3
    assert rows(store.read_table("clinics")) == [(1, 71), (2, 55), (3, 18), (4, 90), (5, 33)]


@pytest.mark.parametrize("backend", list(Backend))
def test_staged_parts_do_not_stay(make, spark, backend):
    store = make(backend)
    for policy in (WritePolicy.UPSERT, WritePolicy.APPEND, WritePolicy.UPSERT):
        store.commit_table("clinics", frame(spark, BATCH), policy)
    left = [n for n in files.names(spark, f"{store.root}/data/clinics") if "-batch-" in n]
    assert all(n in store._latest("clinics")["parts"] for n in left)


def test_one_column_of_a_versioned_table_reads_few_columns(make, spark):
    store = make(Backend.PARQUET_VERSIONED, {"properties": {"site": {"type": "integer", "PrimaryKey": True}}}, extra="keep")
    wide = spark.createDataFrame([(1, 2, "x", 3.0)], "site long, beds long, note string, area double")
    store.commit_table("clinics", wide)
    for read in (store.read_table_column("clinics", "area"), store.primary_keys("clinics")):
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert "note" not in plan and "beds" not in plan
    assert rows(store.read_table_column("clinics", "area")) == [(3.0,)]


def test_versioned_upsert(make, spark):
    store = make(Backend.PARQUET_VERSIONED)
    store.commit_table("clinics", frame(spark, BASE), commit_time=T1)
    batch = frame(spark, [(1, 40), (3, 18), (4, 90), (5, 33)])
    entry = store.commit_table("clinics", batch, commit_time=T2)
    assert entry["rows"] == 3
    stamp = '{{"timestamp": "{}"}}'.format
    assert rows(store.history("clinics")) == sorted(
        [
            (1, 40, 1, False, stamp(T1)),
            (2, 55, 1, False, stamp(T1)),
            (3, 62, 1, False, stamp(T1)),
            (3, 18, 2, False, stamp(T2)),
            (4, 90, 1, False, stamp(T2)),
            (5, 33, 1, False, stamp(T2)),
        ]
    )
    assert rows(store.read_table("clinics")) == [(1, 40), (2, 55), (3, 18), (4, 90), (5, 33)]
    assert rows(store.read_as_of("clinics", T1)) == BASE
    assert store.commit_table("clinics", batch, commit_time=T2) is None


def test_versioned_change_detection_goes_by_name(make, spark):
    store = make(Backend.PARQUET_VERSIONED)
    store.commit_table("clinics", frame(spark, BASE))
    swapped = frame(spark, [(40, 1), (62, None)], "beds long, site long")
    assert store.commit_table("clinics", swapped)["rows"] == 1


def test_versioned_append_skips_seen_keys(make, spark):
    store = make(Backend.PARQUET_VERSIONED, write_policy=WritePolicy.APPEND)
    store.commit_table("clinics", frame(spark, BASE), commit_time=T1)
    store.commit_table("clinics", frame(spark, BATCH), commit_time=T2)
    assert rows(store.history("clinics"), "site", "beds", "_version") == [
        (1, 40, 1),
        (2, 55, 1),
        (3, 62, 1),
        (4, 90, 1),
        (5, 33, 1),
    ]


def test_tombstones(make, spark):
    store = make(Backend.PARQUET_VERSIONED)
    store.commit_table("clinics", frame(spark, BASE), commit_time=T1)
    store.commit_table("clinics", frame(spark, [(1, 71)]), commit_time=T1)
    store.delete_keys("clinics", frame(spark, [(1,), (3,), (8,)], "site long"), commit_time=T2)
    assert rows(store.read_table("clinics")) == [(2, 55)]
    store.tombstone = "skip"
    assert rows(store.read_table("clinics")) == [(1, 71), (2, 55), (3, 62)]
    store.tombstone = "hide"
    store.commit_table("clinics", frame(spark, [(1, 71)]), WritePolicy.APPEND)
    assert rows(store.read_table("clinics")) == [(2, 55)]
    store.commit_table("clinics", frame(spark, [(1, 71)]))
    assert rows(store.read_table("clinics")) == [(1, 71), (2, 55)]
    assert (1, 71, 4) in rows(store.history("clinics"), "site", "beds", "_version")


def test_repeats_of_a_key_share_a_version_and_the_last_row_counts(make, spark):
    store = make(Backend.PARQUET_VERSIONED)
    names = "site long, beds long, ord long"
    store.commit_table("clinics", frame(spark, BASE))
    store.commit_table(
        "clinics", frame(spark, [(1, 40, 3), (1, 18, 1), (2, 55, 2)], names), order_by="ord"
    )
    assert rows(store.history("clinics"), "site", "beds", "_version") == [
        (1, 18, 2),
        (1, 40, 1),
        (1, 40, 2),
        (2, 55, 1),
        (3, 62, 1),
    ]
    assert rows(store.read_table("clinics")) == BASE


def test_versioned_without_key(make, spark):
    store = make(Backend.PARQUET_VERSIONED, NO_KEY)
    store.commit_table("clinics", frame(spark, [(1, 1), (1, 1)]), commit_time=T1)
    store.commit_table("clinics", frame(spark, [(1, 1)]), commit_time=T2)
    assert rows(store.read_table("clinics")) == [(1, 1), (1, 1)]


def test_version_history(make, spark):
    store = make(Backend.PARQUET_VERSIONED)
    store.commit_table("clinics", frame(spark, BASE), commit_time=T1)
    store.commit_table("clinics", frame(spark, [(1, 71)]), commit_time=T2)
    history = store.version_history("clinics")
    assert rows(history, "site", "beds", "_version", "committed_at", "prev_beds", "n_versions") == sorted(
        [
            (1, 40, 1, T1, None, 2),
            (1, 71, 2, T2, 40, 2),
            (2, 55, 1, T1, None, 1),
            (3, 62, 1, T1, None, 1),
        ],
        key=repr,
    )


def test_repeated_delivery_is_ignored(any_store, spark):
    any_store.commit_table("clinics", frame(spark, BASE))
    batch = frame(spark, [(9, 90)])
    assert any_store.commit_table("clinics", batch, source="s", batch_id=0)
    assert any_store.commit_table("clinics", batch, source="s", batch_id=0) is None
    assert any_store.committed_batch("clinics", "s") == 0
    assert any_store.committed_batch("clinics", "other") == -1


def test_missing_table(make):
    with pytest.raises(FileNotFoundError, match="nothing"):
        make().read_table("nothing")


@pytest.mark.parametrize("backend", [Backend.PARQUET, Backend.PARQUET_VERSIONED])
def test_compaction_keeps_the_table(make, spark, backend):
    store = make(backend)
    store.commit_table("clinics", frame(spark, BASE))
    assert store.compact("clinics") is None
    store.commit_table("clinics", frame(spark, BATCH))
    store.commit_table("clinics", frame(spark, [(8, 8)]), WritePolicy.APPEND)
    before = rows(store.read_table("clinics"))
    assert len(store.compact("clinics")["parts"]) == 1
    assert rows(store.read_table("clinics")) == before
    store.commit_table("clinics", frame(spark, [(9, 90)]))
    assert rows(store.read_table("clinics")) == [*before, (9, 90)]


def test_dominant_key_in_a_batch(make, spark):
    store = make(Backend.PARQUET_VERSIONED)
    store.commit_table("clinics", frame(spark, BASE))
    hot = [(1, i) for i in range(500)] + [(i, i) for i in range(10, 600)]
    store.commit_table("clinics", frame(spark, hot))
    assert store.history("clinics").filter("site = 1").count() == 501
    assert rows(store.read_table("clinics").filter("site = 1"))[0][1] in range(500)
    assert store.read_table("clinics").count() == 593


def test_text_keys(make, spark):
    schema = {"properties": {"k": {"type": "string", "PrimaryKey": True}, "v": {"type": "integer"}}}
    store = make(schema=schema)
    names = "k string, v long"
    store.commit_table("clinics", frame(spark, [("a", 1), ("", 2), (None, 3)], names))
    store.commit_table("clinics", frame(spark, [("", 5), ("b", 6)], names))
    assert rows(store.read_table("clinics")) == sorted(
        [("a", 1), (None, 3), ("", 5), ("b", 6)], key=repr
    )


def test_two_frames_for_one_table(make, spark):
    store = make()
    done = store.commit_tables(["clinics", "other", "clinics"], [frame(spark, [(1, 40)]), frame(spark, [(9, 1)]), frame(spark, [(2, 55)])])
    assert rows(store.read_table("clinics")) == [(1, 40), (2, 55)]
    assert set(done) == {"clinics", "other"} and done["clinics"]["version"] == 2
    store.commit_tables([("clinics", frame(spark, [(3, 1)])), ("clinics", frame(spark, [(3, 2)]))])
    assert rows(store.read_table("clinics")) == [(1, 40), (2, 55), (3, 2)]
    assert rows(store.catalog(), "table", "version") == [("clinics", 4), ("other", 1)]


def test_backups_of_one_table_only(make, spark):
    store = make(schema=None, backup_policy=BackupPolicy.TIMESTAMPED_COPIES)
    for name in ("visits", "visits_old"):
        store.commit_table(name, frame(spark, [(1, 2)]), commit_time=T1)
    assert len(store.backups("visits")) == len(store.backups("visits_old")) == 1


def test_commits_take_the_spellings_of_coercion_only(make, spark):
    schema = {"properties": {"site": {"type": "integer"}, "open": {"type": "boolean"}, "size": {"type": "number"}}}
    texts = [(" 7 ", "TRUE", "1.5e3"), ("0x1", "yes", "1e5"), ("1.0", "t", "Infinity"), ("8", "0", "12")]
    batch = spark.createDataFrame(texts, "site string, open string, size string")
    store = make(schema=schema)
    store.commit_table("clinics", batch, on_error="null")
    wanted = [(7, True, 1500.0), (8, None, 12.0), (None, None, None), (None, None, None)]
    assert rows(store.read_table("clinics")) == wanted
    with pytest.raises(Exception, match="column 'open'"):
        store.commit_table("clinics", batch.filter("size = '12'"))
