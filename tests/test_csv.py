import gzip
import random
from contextlib import contextmanager

import pytest
from conftest import rows

from millrace.sources.csv import read_csv_source, write_csv


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_files_meet_by_header_name(spark, tmp_path):
    paths = [put(tmp_path, "a.csv", "x,y\n1,2\n"), put(tmp_path, "b.csv", "y,x\n3,4\n"), put(tmp_path, "c.csv", "y,z\n5,6\n")]
    out = read_csv_source(spark, paths)
    assert rows(out, "x", "y", "z") == sorted([("1", "2", None), ("4", "3", None), (None, "5", "6")], key=repr)
    assert rows(read_csv_source(spark, paths[:1], columns=["x", "y"])) == [("1", "2")]
    with pytest.raises(ValueError, match="columns"):
        read_csv_source(spark, paths[:2], columns=["x", "y"])


def test_records_of_another_length(spark, tmp_path):
    short = put(tmp_path, "short.csv", 'x,y,z\n1\n1,2\n1,"",3\n,,\n')
    assert rows(read_csv_source(spark, short), "x", "y", "z") == sorted(
        [("1", None, None), ("1", "2", None), ("1", None, "3"), (None, None, None)], key=repr
    )
    for extra in ("1,2,3,4", "1,2,3,", '1,2,3,""', "1,2,3,,9", '"a,b",2,3,","'):
        path = put(tmp_path, "long.csv", f"x,y,z\n1,2,3\n{extra}\n")
        for wanted in (["x"], ["z"], ["x", "y", "z"]):
            with pytest.raises(Exception, match="more than 3 cells"):
                read_csv_source(spark, path).select(*wanted).collect()
        with pytest.raises(Exception, match="more than 3 cells"):
            read_csv_source(spark, path).count()
    fine = put(tmp_path, "fine.csv", 'x,y,z\n"1,1","2,""2",3\n')
    assert rows(read_csv_source(spark, fine)) == [("1,1", '2,"2', "3")] and read_csv_source(spark, fine).count() == 1


@contextmanager
def split_at(spark, size):
    """Files are cut into ranges of about so many bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def quoted(cell):
    return '"' + cell.replace('"', '""') + '"' if any(c in cell for c in '",\r\n') else cell


def test_a_file_is_split_whether_or_not_records_span_lines(spark, tmp_path):
    rng = random.Random(7)
    cells = ["", "a", "b,c", "d\ne", '"', 'f"\n"g', "\n\n", "h\r\ni", "x" * 300, "é\n日本", ",", "\n,\n"]
    want = [(str(i), rng.choice(cells), rng.choice(cells)) for i in range(3000)]
    want[700] = ("700", "long\n" * 9000, "y")  # longer than several ranges
    want[2999] = ("2999", "end", "no line end after it")
    for name, end in (("unix.csv", "\n"), ("windows.csv", "\r\n")):
        text = end.join(",".join(map(quoted, row)) for row in [("k", "x", "y"), *want])
        path = tmp_path / name
        path.write_bytes(text.encode())
        with split_at(spark, "8k"):
            out = read_csv_source(spark, str(path), missing=["no such cell"])
            assert out.rdd.getNumPartitions() > 10
            got = sorted(out.collect(), key=lambda r: int(r.k))
        whole = read_csv_source(spark, str(path), missing=["no such cell"])
        assert sorted(whole.collect(), key=lambda r: int(r.k)) == got
        assert [tuple(c or "" for c in r) for r in got] == [tuple(c.replace(end, "\n") for c in r) for r in want]
    flat = put(tmp_path, "flat.csv", "k,x,y\n" + "1,2,3\n\n" * 20000)
    with split_at(spark, "8k"):
        for promise in (None, False, True):
            out = read_csv_source(spark, flat, multi_line=promise)
            assert out.rdd.getNumPartitions() > 10 and out.count() == out.filter("y = '3'").count() == 20000


def test_rows_like_the_header_stay_when_a_file_is_cut(spark, tmp_path):
    path = put(tmp_path, "a b%20é.csv", "\n  \nx,y\n" + 'x,y\n"1\n",2\n' * 2000)
    with split_at(spark, "4k"):
        assert read_csv_source(spark, path).groupBy("x").count().orderBy("x").collect()[1][:] == ("x", 2000)


def test_files_whose_quotes_do_not_tell_records_are_read_whole(spark, tmp_path):
    odd = put(tmp_path, "odd.csv", "x,y\n" + '5" pipe,1\n"a\nb",2\n' * 2000)
    with split_at(spark, "4k"):
        out = read_csv_source(spark, odd)
        assert out.filter("x = '5\" pipe'").count() == out.filter("x = 'a\nb'").count() == 2000
        head = put(tmp_path, "head.csv", '"x\n1",y\n' + '"a\nb",2\n' * 2000)
        assert read_csv_source(spark, head).columns == ["x\n1", "y"] and read_csv_source(spark, head).count() == 2000


def test_plain_small_files_are_not_looked_through(spark, tmp_path, monkeypatch):
    from millrace.sources import csv

    monkeypatch.setattr(csv, "_lines", lambda *a: 1 / 0)
    small = put(tmp_path, "small.csv", 'x,y\n"a\nb",1\nc,2\n')
    assert rows(read_csv_source(spark, small)) == [("a\nb", "1"), ("c", "2")]
    with split_at(spark, "4k"):
        flat = put(tmp_path, "flat.csv", "x,y\n" + "c,2\n" * 20000)
        assert read_csv_source(spark, flat, multi_line=False).count() == 20000


def test_compressed_files_and_many_files(spark, tmp_path):
    path = tmp_path / "z.csv.gz"
    path.write_bytes(gzip.compress(b'x,y\n' + b'"a\nb",1\n' * 5000))
    with split_at(spark, "1k"):
        assert read_csv_source(spark, str(path)).filter("x = 'a\nb'").count() == 5000
    many = [put(tmp_path, f"m{i}.csv", f"{'x,y' if i % 2 else 'y,x'}\n{i},b\n") for i in range(70)]
    out = read_csv_source(spark, many)
    assert out.filter("y = 'b'").count() == 35 and out.filter("x = 'b'").count() == 35


def test_long_cells_in_short_and_surplus_records(spark, tmp_path):
    for cell in ("a" * 30_000, '""' * 30_000, "a,b\n" * 10_000):
        path = put(tmp_path, "short.csv", f'x,y,z\n"{cell}",1\n')
        assert [(len(r.x), r.y, r.z) for r in read_csv_source(spark, path).collect()] == [(len(cell.replace('""', '"')), "1", None)]
        path = put(tmp_path, "surplus.csv", f'x,y,z\n1,2,3\n1,"{cell}",2,3\n')
        with pytest.raises(Exception, match="more than 3 cells"):
            read_csv_source(spark, path).count()


def test_header_only(spark, tmp_path):
    out = read_csv_source(spark, put(tmp_path, "head.csv", "x,y\n"))
    assert out.columns == ["x", "y"] and out.count() == 0


def test_data_columns_named_like_helpers_are_exported(spark, tmp_path):
    stored = spark.createDataFrame([(1, "w", 2)], "Row int, _typed string, v int")
    back = read_csv_source(spark, write_csv(stored, str(tmp_path / "out")))
    assert rows(back, "Row", "_typed", "v") == [("1", "w", "2")]
    staged = spark.createDataFrame([(1, False, 2), (2, True, 3)], "Row int, _delete boolean, v int")
    back = read_csv_source(spark, write_csv(staged, str(tmp_path / "staged")))
    assert back.columns == ["v"] and rows(back) == [("2",)]
