"""Checkpoints that grow: files added, changed and removed; key + new-column tables."""

import os

import pytest
from pyspark.sql import functions as F

from ringlens.sources.incremental import SOURCE, ColumnCheckpoint, list_files, refresh_stage, sweep


@pytest.fixture
def stage(spark, tmp_path):
    """(write a file, refresh the stage table, paths that build was given)."""
    source, base, parsed = tmp_path / "in", str(tmp_path / "stage"), []
    source.mkdir()

    def write(name, numbers, stamp):
        path = source / f"{name}.csv"
        path.write_text("\n".join(f"{n},{name}" for n in numbers))
        os.utime(path, (stamp, stamp))

    def build(paths):
        parsed.append(sorted(os.path.basename(p) for p in paths))
        rows = spark.read.schema("n long, name string").csv(paths)
        return rows.select((F.col("n") * 2).alias("twice"), "name", F.col("_metadata.file_path").alias(SOURCE))

    def refresh(**kw):
        return refresh_stage(spark, str(source), base, build, **kw)

    return source, base, parsed, write, refresh


def twice(result):
    return sorted((r.name, r.twice) for r in result.rows.collect())


def names(paths):
    return [os.path.basename(p) for p in paths]


def test_only_new_and_changed_files_are_parsed(stage, spark):
    source, base, parsed, write, refresh = stage
    write("a", [1, 2], 100)
    write("b", [3], 100)
    write("none", [], 100)
    first = refresh()
    assert twice(first) == [("a", 2), ("a", 4), ("b", 6)] and parsed == [["a.csv", "b.csv", "none.csv"]] and first.n_rows == 3
    same = refresh()
    assert twice(same) == twice(first) and len(parsed) == 1 and len(same.kept) == 3 and not same.parsed
    write("c", [9], 200)  # one more file
    assert twice(refresh()) == [("a", 2), ("a", 4), ("b", 6), ("c", 18)] and parsed[-1] == ["c.csv"]
    write("a", [5], 300)  # one with other rows
    assert twice(refresh()) == [("a", 10), ("b", 6), ("c", 18)] and parsed[-1] == ["a.csv"]
    os.remove(source / "b.csv")  # one less: nothing is parsed
    gone = refresh()
    assert twice(gone) == [("a", 10), ("c", 18)] and names(gone.removed) == ["b.csv"] and len(parsed) == 3
    before = len(list_files(spark, f"{base}/rows"))
    assert sweep(spark, base) and len(list_files(spark, f"{base}/rows")) < before
    assert twice(refresh()) == [("a", 10), ("c", 18)] and len(parsed) == 3


def test_other_rules_and_interrupted_writes(stage, spark):
    _, base, parsed, write, refresh = stage
    write("a", [1], 100)
    refresh(rules="one")
    (lambda p: (os.makedirs(p), open(f"{p}/part-0.parquet", "w").write("broken")))(f"{base}/rows/interrupted/part=0")
    assert twice(refresh(rules="one")) == [("a", 2)] and len(parsed) == 1
    assert twice(refresh(rules="two")) == [("a", 2)] and len(parsed) == 2
    assert any("interrupted" in p for p in sweep(spark, base)) and twice(refresh(rules="two")) == [("a", 2)]


def test_checks_keep_the_manifest_before(stage):
    _, _, parsed, write, refresh = stage
    write("a", [1, 2], 100)
    assert refresh(min_rows=2, min_bytes=10, expected_cols=["twice", "name"]).n_bytes > 10
    write("a", [1], 200)
    for wrong in ({"min_rows": 2}, {"min_bytes": 10 ** 9}, {"expected_cols": ["thrice"]}):
        with pytest.raises(ValueError):
            refresh(**wrong)
    assert twice(refresh(min_rows=1)) == [("a", 2)] and parsed[-1] == ["a.csv"]


def test_no_files_at_all(stage):
    _, _, parsed, write, refresh = stage
    nothing = refresh()
    assert nothing.rows is None and nothing.n_rows == 0 and not parsed


def test_column_checkpoint(spark, tmp_path):
    check = ColumnCheckpoint(spark, str(tmp_path / "scores"), key="url")
    calls = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("b", 4)], "url string, n int")

    def score(df):
        return df.select("url", F.length("url").alias("score"), F.col("n").alias("seen"))

    assert check.table() is None and check.missing(calls).count() == 4 and check.attach(calls).columns == ["url", "n"]
    check.add(score(calls))
    got = sorted(((r.url, r.n, r.score, r.seen) for r in check.attach(calls).collect()), key=str)
    assert got == sorted([("a", 1, 1, 1), ("b", 2, 1, 2), (None, 3, None, None), ("b", 4, 1, 2)], key=str)
    more = calls.unionByName(spark.createDataFrame([("ccc", 5)], calls.schema))
    todo = check.missing(more)
    assert sorted(str(r.url) for r in todo.collect()) == ["None", "ccc"]
    check.add(score(todo))
    check.add(spark.createDataFrame([("a", 70, "new")], "url string, score int, tag string"))  # a later version, one more column
    for _ in range(2):
        by = {r.url: (r.score, r.tag) for r in check.attach(more, fill={"tag": "none"}).collect()}
        assert by == {"a": (70, "new"), "b": (1, "none"), "ccc": (3, "none"), None: (None, "none")}
        check.compact()
    assert len(check._versions()) == 1
