"""Tables kept as numbered snapshots, of which the last committed one counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Snapshots that stay behind the current one, for readers that began before a commit.
KEPT = 1
_MARKS, _DATA = "_committed", "snapshots"


def _fs(spark: SparkSession, path: str):
    """The file system of a path and how to make paths of it: any store that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _named(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it is not there."""
    fs, at = _fs(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(at(folder))) if fs.exists(at(folder)) else []


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the committed snapshots, the current one last."""
    return _named(spark, f"{path}/{_MARKS}")


def read_snapshot(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The table as last committed, or as it was in an earlier snapshot that is still there.

    What a writer that failed left behind has no mark and is never read. A table that was
    never committed is an error.
    """
    names = committed(spark, path)
    if not names or (name and name not in names):
        raise FileNotFoundError(f"{path} has no committed snapshot{f' {name}' if name else ''}")
    return spark.read.parquet(f"{path}/{_DATA}/{name or names[-1]}")


def write_snapshot(df: DataFrame, path: str, kept: int = KEPT) -> str:
    """Make df the table at path; its name is returned.

    The rows are written as a snapshot of their own, also if they are read from the one
    before. Then an empty file with its number and name is created: that is the commit, one
    step that happens or does not. A failure before it leaves the old rows, one after it the
    new ones. Only then older snapshots go, but for `kept` of them, and what failed writers
    left; what could not be deleted goes with the next commit.

    One writer at a time: of two that commit the same number, the one whose mark does not
    count gets an error and may try again. A writer that is overtaken by more than `kept`
    commits while it writes may find its files gone; it fails then, without a mark.
    """
    spark = df.sparkSession
    names = committed(spark, path)
    number = int(names[-1].split("-")[0]) + 1 if names else 1
    name = f"{number:012d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{_DATA}/{name}")
    _commit(spark, path, name)
    _sweep(spark, path, kept)
    return name


def _commit(spark: SparkSession, path: str, name: str) -> None:
    fs, at = _fs(spark, path)
    if not fs.createNewFile(at(f"{path}/{_MARKS}/{name}")):
        raise OSError(f"{name} cannot be committed in {path}")
    number = name.split("-")[0]
    same = [n for n in committed(spark, path) if n.split("-")[0] == number]
    if same[-1] != name:
        fs.delete(at(f"{path}/{_MARKS}/{name}"), False)
        raise RuntimeError(f"{path} was committed by another writer as {same[-1]}")


def _sweep(spark: SparkSession, path: str, kept: int) -> None:
    """Delete all but the last snapshots: marks first, so none counts without its rows."""
    fs, at = _fs(spark, path)
    names = committed(spark, path)
    stay = set(names[-1 - kept :])
    for n in names:
        if n not in stay:
            fs.delete(at(f"{path}/{_MARKS}/{n}"), False)
    for n in _named(spark, f"{path}/{_DATA}"):
        # A snapshot with the current number or a later one may be one that is being written.
        if n not in stay and n.split("-")[0] < max(stay).split("-")[0]:
            fs.delete(at(f"{path}/{_DATA}/{n}"), True)
