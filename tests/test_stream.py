import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace import Backend, TableStore, WritePolicy
from millrace.streaming.commit import stream_commit

SCHEMA = {
    "properties": {
        "k": {"type": "integer", "PrimaryKey": True},
        "v": {"type": "integer", "minimum": 0},
    }
}


@pytest.fixture
def feed(spark, tmp_path):
    folder = str(tmp_path / "feed")

    def send(data):
        spark.createDataFrame(data, "k string, v string").coalesce(1).write.mode("append").json(folder)

    send([])
    stream = spark.readStream.schema("k string, v string").option("maxFilesPerTrigger", 1).json(folder)
    return send, stream


@pytest.mark.parametrize("backend", list(Backend))
def test_stream_splits_good_and_bad_rows(spark, tmp_path, feed, backend):
    send, stream = feed
    store = TableStore(spark, str(tmp_path / "store"), backend)
    store.put_schema("t", SCHEMA)
    checkpoint = str(tmp_path / "checkpoint")

    def run():
        stream_commit(stream, store, "t", checkpoint, f"s-{backend.value}", rejects="bad").awaitTermination()

    send([("1", "5"), ("2", "-1")])
    run()
    assert rows(store.read_table("t")) == [(1, 5)]
    send([("1", "6"), ("x", "1"), ("3", "7")])
    run()
    assert rows(store.read_table("t")) == [(1, 6), (3, 7)]
    assert rows(store.read_table("bad"), "k", "v") == [("2", "-1"), ("x", "1")]
    keywords = F.get_json_object("_errors", "$[0].keyword")
    assert rows(store.read_table("bad").select(keywords)) == [("minimum",), ("type",)]
    log = store.commit_log("t").count()
    run()
    assert store.commit_log("t").count() == log


def test_batch_delivered_again_changes_nothing(spark, tmp_path, feed):
    send, stream = feed
    store = TableStore(spark, str(tmp_path / "store"))
    store.put_schema("t", {"properties": {"k": {"type": "string"}, "v": {"type": "string"}}})
    checkpoint = tmp_path / "checkpoint"
    send([("1", "5")])

    def run():
        stream_commit(stream, store, "t", str(checkpoint), "again", WritePolicy.APPEND).awaitTermination()

    run()
    assert rows(store.read_table("t")) == [("1", "5")]
    # As after a failure between the commit and Spark's own note of it.
    for note in (checkpoint / "commits").iterdir():
        note.unlink()
    run()
    assert rows(store.read_table("t")) == [("1", "5")]


def test_new_checkpoint_under_an_old_name_is_a_new_stream(spark, tmp_path, feed):
    send, stream = feed
    store = TableStore(spark, str(tmp_path / "store"))
    store.put_schema("t", {"properties": {"k": {"type": "string"}, "v": {"type": "string"}}})
    for attempt in range(2):
        send([(str(attempt), "5")])
        part = stream.filter(F.col("k") == str(attempt))
        stream_commit(
            part, store, "t", str(tmp_path / f"checkpoint{attempt}"), "again", WritePolicy.APPEND
        ).awaitTermination()
    assert rows(store.read_table("t")) == [("0", "5"), ("1", "5")]
