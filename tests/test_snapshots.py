"""A table's rows after a failure at every step of a replacement: the old ones or the new ones."""

from pathlib import Path

import pytest

from lodestar.sources import readers as R
from lodestar.sources import snapshots as S


def ids(df):
    return sorted(r[0] for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    S.write_snapshot(spark.range(3), path)
    return path


def test_a_table_is_replaced_by_what_is_read_from_it(spark, table):
    for k in range(3, 7):
        S.write_snapshot(S.read_snapshot(spark, table).union(spark.range(k, k + 1)), table)
        assert ids(S.read_snapshot(spark, table)) == list(range(k + 1))
    names = S.committed(spark, table)
    assert len(names) == 2 and ids(S.read_snapshot(spark, table, names[0])) == list(range(6))
    assert sorted(p.name for p in Path(table, "snapshots").iterdir()) == names


def test_a_table_that_was_never_committed_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.read_snapshot(spark, str(tmp_path / "none"))
    spark.range(2).write.parquet(str(tmp_path / "t/snapshots/000000000001-x"))
    with pytest.raises(FileNotFoundError):
        S.read_snapshot(spark, str(tmp_path / "t"))


class Stop(Exception):
    pass


@pytest.mark.parametrize("step", range(12))
def test_a_failure_at_every_step(spark, table, monkeypatch, step):
    """Every call of the file system and of the writer in turn fails, before or after it has done its work."""
    at, late = divmod(step, 2)
    real_fs, real_commit, calls = S._fs, S._commit, []

    class Fs:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            def call(*a):
                if name not in ("createNewFile", "delete"):
                    return getattr(self.fs, name)(*a)
                calls.append(name)
                if len(calls) == at and not late:
                    raise Stop
                found = getattr(self.fs, name)(*a)
                if len(calls) == at:
                    raise Stop
                return found

            return call

    def commit(*a):
        if at == 0 and not late:
            raise Stop
        return real_commit(*a)

    S.write_snapshot(spark.range(1), table)
    S.write_snapshot(spark.range(4), table)
    with monkeypatch.context() as m:
        m.setattr(S, "_fs", lambda *a: (lambda fs, p: (Fs(fs), p))(*real_fs(*a)))
        m.setattr(S, "_commit", commit)
        try:
            S.write_snapshot(spark.range(9), table)
            failed = False
        except Stop:
            failed = True
    now = ids(S.read_snapshot(spark, table))
    assert now in ([0, 1, 2, 3], list(range(9))) and (failed or now == list(range(9)))
    assert now == ([0, 1, 2, 3] if failed and (step == 0 or step == 2) else list(range(9)))
    for k in (20, 21):
        S.write_snapshot(S.read_snapshot(spark, table).union(spark.range(k, k + 1)), table)
    assert ids(S.read_snapshot(spark, table)) == [*now, 20, 21]
    assert len(S.committed(spark, table)) == 2 == len(list(Path(table, "snapshots").iterdir()))


def test_of_two_writers_of_one_number_one_fails(spark, table, monkeypatch):
    real = S._commit

    def slow(s, path, name):
        monkeypatch.setattr(S, "_commit", real)
        other = f"{name.split('-')[0]}-zz"  # sorts after any uuid
        spark.range(7).write.parquet(f"{path}/snapshots/{other}")
        real(s, path, other)
        real(s, path, name)

    monkeypatch.setattr(S, "_commit", slow)
    with pytest.raises(RuntimeError, match="another writer"):
        S.write_snapshot(spark.range(5), table)
    assert ids(S.read_snapshot(spark, table)) == list(range(7))


def test_a_table_set_aside_comes_back(spark, tmp_path):
    """replace_table() after a crash between its two renames keeps the old rows until the new ones are in place."""
    path = tmp_path / "t"
    R.replace_table(spark.range(3), str(path))
    path.rename(tmp_path / "t.before")
    R.recover_table(spark, str(path))
    assert ids(spark.read.parquet(str(path))) == [0, 1, 2]
    path.rename(tmp_path / "t.before")
    with pytest.raises(Exception, match="boom"):
        R.replace_table(spark.range(5).selectExpr("raise_error('boom') AS id"), str(path))
    assert ids(spark.read.parquet(str(path))) == [0, 1, 2]
    path.rename(tmp_path / "t.before")
    R.replace_table(spark.range(6), str(path))
    assert ids(spark.read.parquet(str(path))) == list(range(6)) and not (tmp_path / "t.before").exists()
