"""The ingest flow end to end, on a small clinic file with every kind of slip."""

import pytest
from conftest import rows

from millrace import Project
from millrace.operators import review
from millrace.operators.mapping import FieldMap, apply_mapping
from millrace.operators.validate import error_log, verdict
from millrace.plans.ingest import apply_edits, commit, ingest
from millrace.sources.csv import read_csv_source, write_csv

SCHEMA = {
    "type": "object",
    "properties": {
        "Visit No": {"type": "integer", "PrimaryKey": True},
        "Weight": {"type": "number", "minimum": 0},
        "Result": {"type": ["string", "null"], "enum": ["Positive", "Negative", None]},
        "Ward": {"type": ["string", "null"], "enum": ["North", "South"]},
        "Complaints": {"type": ["array", "null"], "items": {"type": "string"}},
        "Seen": {"type": "string", "format": "date"},
        "Nights": {"type": ["integer", "null"]},
    },
    "required": ["Visit No", "Weight"],
    "additionalProperties": False,
}
MAPPING = {
    "Visit No": "no",
    "Weight": "kg",
    "Result": FieldMap("outcome", {"pos": "Positive", "neg": "Negative"}),
    "Ward": FieldMap("ward", {"n": "North", "s": "South", "none": "South"}),
    "Complaints": "complaints",
    "Seen": "day",
    "Nights": "nights",
}
SOURCE = '''no,kg,outcome,ward,complaints,day,nights,ignored
001,80.5,pos,n,"cough, fever",03/04/2024,2,x
002,-1,Negative,s,"cough, fever",03/04/2024,N/A,x
003,75,maybe,n,"cough, fever",03/04/2024,1,x
004,60,N/A,None,"[ache]",04/04/2024,,x
005,heavy,neg,none,"cough",04/04/2024,one,x
006,91,neg,s,"""cough"", 'fever'",05/04/2024,3,x
006,92,pos,s,N/A,06/04/2024,4,"two
lines"
'''
ERRORS = [
    (2, "Weight", "minimum"),
    (3, "Result", "enum"),
    (4, "Ward", "enum"),
    (5, "Complaints", "type"),
    (5, "Nights", "type"),
    (5, "Weight", "type"),
]


@pytest.fixture
def clinic(spark, tmp_path):
    made = Project(spark, str(tmp_path / "clinic"))
    made.store.put_schema("visits", SCHEMA)
    source = tmp_path / "source.csv"
    source.write_text(SOURCE)

    @made.mapper("clinic")
    def mapper(df):
        return {"visits": apply_mapping(df, MAPPING)}

    return made, str(source)


def test_rows_are_validated(clinic):
    project, source = clinic
    staged = ingest(project, "clinic", source)["visits"]
    assert rows(staged.rows, "Row", "Visit No")[-1] == (7, "006")
    assert rows(staged.errors(), "Row", "path", "keyword") == ERRORS
    assert rows(verdict(staged.rows)) == [(7, 4, 0, False)]
    lines = dict(rows(error_log(staged.rows)))
    assert lines[2] == "Row 2 - 'Weight': -1 is less than the minimum of 0"


def test_good_rows_are_committed(clinic):
    project, source = clinic
    staged = ingest(project, "clinic", source)
    batch = staged["visits"]
    batch.rows = review.reject_error_rows(batch.rows)
    assert rows(review.review_stats(batch.rows)) == [(7, 7, 4)]
    commit(project, staged)
    stored = project.store.read_table("visits")
    assert stored.columns == list(SCHEMA["properties"])
    assert rows(stored) == [
        (1, 80.5, "Positive", "North", "[cough, fever]", "03/04/2024", 2),
        (6, 91.0, "Negative", "South", "[cough, fever]", "05/04/2024", 3),
        (6, 92.0, "Positive", "South", None, "06/04/2024", 4),
    ]
    out = project.sql('SELECT "Ward", count(*) AS n FROM visits WHERE "Visit No" > 0 GROUP BY "Ward"')
    assert rows(out) == [("North", 1), ("South", 2)]


def test_edits_are_validated_again(clinic, spark):
    project, source = clinic
    batch = ingest(project, "clinic", source)["visits"]
    edited = spark.createDataFrame(
        [(3, "Positive", "North"), (4, None, "South")], "Row long, Result string, Ward string"
    )
    again = apply_edits(batch, edited)
    assert sorted({r[0] for r in rows(again.errors(), "Row")}) == [2, 5]
    assert rows(again.rows.filter("Row = 4"), "Result", "Ward") == [(None, "South")]
    changed = review.cell_diff(batch.rows, again.rows)
    assert rows(changed) == [(3, "Result", "maybe", "Positive"), (4, "Ward", None, "South")]


def test_relaxed_schema_turns_errors_into_warnings(clinic):
    project, source = clinic
    relaxed = {"properties": {"Visit No": {"type": "integer"}, "Weight": {"type": "number"}}}
    project.store.put_schema("visits", relaxed, relaxed=True)
    batch = ingest(project, "clinic", source)["visits"]
    found = batch.errors()
    assert rows(found.filter("severity = 'error'"), "Row", "path") == [(5, "Weight")]
    assert rows(found.filter("severity = 'warning'"), "Row", "path", "keyword") == ERRORS


def test_append_leaves_existing_records(clinic):
    project, source = clinic
    for update_existing in (True, False):
        staged = ingest(project, "clinic", source)
        batch = staged["visits"]
        batch.rows = review.reject_error_rows(batch.rows)
        commit(project, staged, update_existing=update_existing)
    assert project.store.read_table("visits").count() == 3


def test_csv_round_trip(clinic, spark, tmp_path):
    project, source = clinic
    raw = read_csv_source(spark, source)
    assert raw.columns == ["no", "kg", "outcome", "ward", "complaints", "day", "nights", "ignored"]
    assert raw.filter("ward IS NULL").count() == 1
    assert rows(raw.filter("no = '006'"), "complaints")[0] == ("\"cough\", 'fever'",)
    path = write_csv(raw, str(tmp_path / "out"))
    assert rows(read_csv_source(spark, path)) == rows(raw)


def test_csv_is_split_only_without_line_breaks_in_cells(spark, tmp_path):
    plain = tmp_path / "plain.csv"
    plain.write_text("a,b\n" + "\n".join(f'{i},"x, ""y"" {i}"' for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 8192)
        df = read_csv_source(spark, str(plain))
        assert df.rdd.getNumPartitions() > 1
        assert df.count() == 2000
        assert rows(df.filter("a = '7'")) == [("7", 'x, "y" 7')]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_missing_tokens(spark, tmp_path):
    path = tmp_path / "tokens.csv"
    cells = ["NA", "none", "None", "", '""', " NA", "nan", "x"]
    path.write_text("a,b\n" + "\n".join(f"1,{c}" for c in cells))
    found = [r.b for r in read_csv_source(spark, str(path)).collect()]
    assert found == [None, "none", None, None, None, " NA", None, "x"]
