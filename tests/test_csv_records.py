"""The split CSV reader: equal to the one-task reader wherever a split falls, with quoted line breaks."""

import csv
import io
import random

import pytest

from ringlens.sources import csv_records as R


@pytest.fixture
def small_splits(spark):
    """Splits of a few bytes, one to a task."""
    conf = {"spark.sql.files.maxPartitionBytes": "37", "spark.sql.files.openCostInBytes": "37", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write(path, rows, end="\n", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=quoting).writerows(rows)
    path.write_bytes(out.getvalue().encode())


def one_task(spark, path, columns):
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return sorted((tuple(r) for r in reader.schema(", ".join(f"{c} string" for c in columns)).csv(str(path)).collect()), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def fields(rng, n):
    bits = ["a", "é", "\n", '"', ",", "\r\n", "\n\n", '""', "word ", "\n,\n", " "]
    return [[str(i), "".join(rng.choice(bits) for _ in range(rng.randrange(9))), rng.choice(["x", "", "y,z", 'say "hi"'])] for i in range(n)]


@pytest.mark.parametrize("quoting", [csv.QUOTE_MINIMAL, csv.QUOTE_ALL])
def test_splits_equal_the_one_task_reader(small_splits, tmp_path, quoting):
    rng = random.Random(quoting)
    columns = ["id", "text", "tag"]
    for name in ("one", "two"):
        write(tmp_path / f"{name}.csv", [columns, *fields(rng, 80)], quoting=quoting)
    df = R.read_csv(small_splits, str(tmp_path), columns)
    assert R._lines(small_splits, str(tmp_path)).rdd.getNumPartitions() > 40
    marks = R.split_marks(R._lines(small_splits, str(tmp_path)))
    assert marks.where("inside = 1").count() > 5 and marks.where("inside = 0").count() > 5
    got = rows_of(df)
    assert len(got) == 160 and got == one_task(small_splits, tmp_path, columns)


def test_every_border_of_one_file(spark, tmp_path):
    """The same file cut at every width: borders fall before, in and after quotes and line breaks."""
    write(tmp_path / "f.csv", [["id", "text"], ["1", "a\nb"], ["2", 'q"\n\n"q'], ["3", ""], ["4", "\n" * 9], ["5", "plain"]])
    want = one_task(spark, tmp_path, ["id", "text"])
    for width in (3, 5, 8, 13, 21):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(width))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            assert rows_of(R.read_csv(spark, str(tmp_path), ["id", "text"])) == want, width
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))


def test_line_ends_blank_lines_and_empty_files(small_splits, tmp_path):
    write(tmp_path / "crlf.csv", [["id", "text"], ["1", "a\r\nb"], ["2", "c"]], end="\r\n")
    (tmp_path / "blank.csv").write_text('id,text\n\n3,"x\n\ny"\n\n4,z')
    (tmp_path / "header.csv").write_text("id,text\n")
    (tmp_path / "empty.csv").write_text("")
    assert rows_of(R.read_csv(small_splits, str(tmp_path), ["id", "text"])) == [("1", "a\r\nb"), ("2", "c"), ("3", "x\n\ny"), ("4", "z")]


def test_marks_beyond_the_broadcast_bound(small_splits, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_SPLITS", 0)
    write(tmp_path / "f.csv", [["id", "text", "tag"], *fields(random.Random(5), 60)])
    df = R.read_csv(small_splits, str(tmp_path), ["id", "text", "tag"])
    assert rows_of(df) == one_task(small_splits, tmp_path, ["id", "text", "tag"])


def test_long_records_cross_many_splits(small_splits, tmp_path):
    write(tmp_path / "f.csv", [["id", "text"], ["1", "line\n" * 200], ["2", "b"], ["3", "\n" * 300 + '"']])
    assert rows_of(R.read_csv(small_splits, str(tmp_path), ["id", "text"])) == [("1", "line\n" * 200), ("2", "b"), ("3", "\n" * 300 + '"')]
