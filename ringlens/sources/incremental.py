"""Checkpoints that grow with their input instead of being built anew.

``refresh_stage`` keeps a stage table whose rows are derived file by file. Beside the rows
stands a manifest: which input files they come from, with size, modification time and number of
rows. A refresh parses only files that are new or changed and leaves out the rows of files
that are gone; the rows of all others are read as they are.

``ColumnCheckpoint`` keeps key + new-column tables (scores of a text, for instance): rows whose key
is known are not computed again, and what is added later counts for its keys.

A write is whole or not there: rows are read only through a manifest, and a manifest is
written to a name of its own before it is renamed to its number. Of two sessions that
refresh at once one fails and may try again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column that a stage's rows carry: the path of the input file they come from.
SOURCE = "source_file"


@dataclass(frozen=True)
class InputFile:
    path: str
    size: int
    modified: int


@dataclass(frozen=True)
class Entry:
    """An input file whose rows are stored: in which folder, how many, under which rules."""
    path: str
    size: int
    modified: int
    folder: str
    rows: int


@dataclass(frozen=True)
class Refresh:
    """What a refresh did, and the table it left."""
    rows: DataFrame | None
    parsed: list[str]
    removed: list[str]
    kept: list[str]
    n_rows: int
    n_bytes: int


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _path(spark: SparkSession, *parts: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))


def list_files(spark: SparkSession, path: str) -> list[InputFile]:
    """The data files below ``path`` (or ``path`` itself), by full name; names that begin with _ or . are not data."""
    fs, root = _fs(spark, path)
    found, it = [], fs.listFiles(root, True)
    while it.hasNext():
        st = it.next()
        if not st.getPath().getName().startswith(("_", ".")):
            found.append(InputFile(st.getPath().toString(), int(st.getLen()), int(st.getModificationTime())))
    return sorted(found, key=lambda f: f.path)


def _manifests(spark: SparkSession, base: str) -> list[int]:
    fs, root = _fs(spark, f"{base}/manifest")
    if not fs.exists(root):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(root)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def _read_manifest(spark: SparkSession, base: str, number: int) -> tuple[str, list[Entry]]:
    text = "\n".join(r[0] for r in spark.read.text(f"{base}/manifest/{number}.json").collect())
    held = json.loads(text)
    return held["rules"], [Entry(**e) for e in held["files"]]


def _write_manifest(spark: SparkSession, base: str, number: int, rules: str, entries: list[Entry]) -> None:
    fs, own = _fs(spark, f"{base}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(own, False)
    out.write(bytearray(json.dumps({"rules": rules, "files": [asdict(e) for e in entries]}).encode()))
    out.close()
    final = _path(spark, base, "manifest", f"{number}.json")
    if fs.exists(final) or not fs.rename(own, final):
        raise RuntimeError(f"another session wrote {final.toString()} at the same time; refresh again")


def refresh_stage(spark: SparkSession, inputs: list[InputFile] | str, base: str, build: Callable[[list[str]], DataFrame], rules: str = "",
                  expected_cols: list[str] | None = None, min_rows: int = 0, min_bytes: int = 0) -> Refresh:
    """The stage table below ``base`` for ``inputs``, parsing only what it does not hold.

    ``build(paths)`` gives the rows of some files with a column ``source_file`` (``_metadata.file_path``
    of the read); it must treat files independently. Other ``rules`` (a hash of the stage's code and
    parameters) hold none of the old rows. A table that lacks ``expected_cols``, or is smaller than
    ``min_rows`` or ``min_bytes``, is an error, and the manifest before it stays the last one.
    """
    base = base.rstrip("/")
    files = list_files(spark, inputs) if isinstance(inputs, str) else list(inputs)
    numbers = _manifests(spark, base)
    held_rules, held = _read_manifest(spark, base, numbers[-1]) if numbers else (rules, [])
    known = {(e.path, e.size, e.modified): e for e in held} if held_rules == rules else {}
    kept = [known[f.path, f.size, f.modified] for f in files if (f.path, f.size, f.modified) in known]
    todo = [f for f in files if (f.path, f.size, f.modified) not in known]
    there = {f.path for f in files}
    added: list[Entry] = []
    if todo:
        folder = f"{base}/rows/{uuid.uuid4().hex}"
        number = {f.path: i for i, f in enumerate(todo)}
        numbered = spark.createDataFrame([(_plain(p), i) for p, i in number.items()], f"{SOURCE} string, part int")
        plain = F.regexp_replace(F.col(SOURCE), "^file:/+", "/")
        rows = build([f.path for f in todo]).withColumn(SOURCE, plain)
        # the list of files is as long as the listing the driver holds
        rows.join(numbered, SOURCE).write.partitionBy("part").parquet(folder)
        counts = {r["part"]: r["n"] for r in spark.read.parquet(folder).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()} \
            if list_files(spark, folder) else {}
        added = [Entry(f.path, f.size, f.modified, f"{folder}/part={i}", int(counts.get(i, 0))) for f, i in ((f, number[f.path]) for f in todo)]
    entries = sorted(kept + added, key=lambda e: e.path)
    live = [e.folder for e in entries if e.rows]
    table = spark.read.parquet(*live) if live else None
    n_rows, n_bytes = sum(e.rows for e in entries), sum(f.size for folder in live for f in list_files(spark, folder)) if min_bytes else 0
    if expected_cols and live and not set(expected_cols) <= set(table.columns):
        raise ValueError(f"stage table below {base} lacks {sorted(set(expected_cols) - set(table.columns))}")
    if n_rows < min_rows or n_bytes < min_bytes:
        raise ValueError(f"stage table below {base} has {n_rows} rows and {n_bytes} bytes, less than {min_rows} and {min_bytes}")
    removed = sorted({e.path for e in held} - there)
    if todo or removed or not numbers or held_rules != rules:
        _write_manifest(spark, base, (numbers[-1] if numbers else 0) + 1, rules, entries)
    return Refresh(table, [f.path for f in todo], removed, [e.path for e in kept], n_rows, n_bytes)


def _plain(path: str) -> str:
    """A local path without its scheme: readers and listings spell it differently."""
    return "/" + path.split(":", 1)[1].lstrip("/") if path.startswith("file:") else path


def sweep(spark: SparkSession, base: str) -> list[str]:
    """Delete what no current manifest names (rows of changed and vanished files, interrupted writes); what was deleted.

    For quiet times: a reader of the table before the last refresh would lose its files.
    """
    base = base.rstrip("/")
    numbers = _manifests(spark, base)
    if not numbers:
        return []
    live = {e.folder for e in _read_manifest(spark, base, numbers[-1])[1] if e.rows}
    fs, root = _fs(spark, f"{base}/rows")
    gone = []
    for batch in fs.listStatus(root) if fs.exists(root) else []:
        parts = [st.getPath() for st in fs.listStatus(batch.getPath()) if st.getPath().getName().startswith("part=")]
        tail = {f"{batch.getPath().getName()}/{p.getName()}" for p in parts}
        kept = {t for t in tail if any(f.endswith("/" + t) for f in live)}
        for p in [batch.getPath()] if not kept else [q for q in parts if f"{batch.getPath().getName()}/{q.getName()}" not in kept]:
            fs.delete(p, True)
            gone.append(p.toString())
    for n in numbers[:-1]:
        fs.delete(_path(spark, base, "manifest", f"{n}.json"), False)
    return gone


class ColumnCheckpoint:
    """A key + new-column table that is added to: ``missing`` rows are computed once, ``attach`` joins what is known.

    Every addition is a version of its own; of several values for one key the latest version's holds, and
    within a version the smallest row. ``compact`` writes one version of all.
    """

    def __init__(self, spark: SparkSession, base: str, key: str = "call_url"):
        self.spark, self.base, self.key = spark, base.rstrip("/"), key

    def _versions(self) -> list[int]:
        fs, root = _fs(self.spark, self.base)
        if not fs.exists(root):
            return []
        names = [st.getPath() for st in fs.listStatus(root) if st.isDirectory()]
        done = [p for p in names if p.getName().isdigit() and fs.exists(_path(self.spark, p.toString(), "_SUCCESS"))]
        return sorted(int(p.getName()) for p in done)

    def table(self) -> DataFrame | None:
        """(key, new columns), one row for each key; None before the first addition."""
        versions = self._versions()
        if not versions:
            return None
        parts = [self.spark.read.parquet(f"{self.base}/{v}").withColumn("_version", F.lit(-v)) for v in versions]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        new = [c for c in rows.columns if c not in (self.key, "_version")]
        latest = F.min(F.struct("_version", *new)).alias("_new")  # the latest version has the smallest number
        return rows.groupBy(self.key).agg(latest).select(self.key, *[F.col("_new").getField(c).alias(c) for c in new])

    def missing(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose key has no entry (null keys never have one)."""
        known = self.table()
        return df if known is None else df.join(known.select(self.key), self.key, "left_anti")

    def add(self, rows: DataFrame) -> None:
        """Store (key, new columns) as the latest version; null keys are left out."""
        versions = self._versions()
        rows.where(F.col(self.key).isNotNull()).write.mode("errorifexists").parquet(f"{self.base}/{(versions[-1] if versions else 0) + 1}")

    def attach(self, df: DataFrame, fill: dict | None = None) -> DataFrame:
        """Left join of the new columns; ``fill`` replaces nulls, keys without an entry included."""
        known = self.table()
        if known is None:
            return df
        new = [c for c in known.columns if c != self.key]
        out = df.drop(*[c for c in new if c in df.columns]).join(known, self.key, "left")
        return out.na.fill(fill) if fill else out

    def compact(self) -> None:
        """One version that holds every key; the versions before it are deleted after it is whole."""
        versions = self._versions()
        if len(versions) < 2:
            return
        self.add(self.table())
        fs, _ = _fs(self.spark, self.base)
        for v in versions:
            fs.delete(_path(self.spark, self.base, str(v)), True)
