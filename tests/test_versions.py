"""Versioned tables: readers keep their version, dead writes leave no trace, two writers don't overwrite each other."""

import datetime

import pytest
from pyspark.sql import functions as F

from barloom.session import work_dir
from barloom.sources import versions as S

DAY = datetime.date(2024, 5, 1)


def rows(spark, first, n, value):
    data = [(f"s{k}", DAY + datetime.timedelta(first + i), float(value + k)) for i in range(n) for k in range(3)]
    return spark.createDataFrame(data, "series string, date date, value double")


def content(df):
    return sorted((r.series, r.date, r.value) for r in df.select("series", "date", "value").collect())


def test_replace_and_pinned_readers(spark):
    path = work_dir(spark, "t")
    with pytest.raises(FileNotFoundError):
        S.read_version(spark, path)
    assert S.commit_replace(rows(spark, 0, 2, 1), path) == 1
    old = S.read_version(spark, path)
    assert S.commit_replace(S.read_version(spark, path).withColumn("value", F.col("value") * 2), path) == 2  # reads what it replaces
    assert content(old) == content(rows(spark, 0, 2, 1)) == content(S.read_version(spark, path, 1))
    assert [v for *_, v in content(S.read_version(spark, path))] == [v * 2 for *_, v in content(old)]
    S.commit_replace(rows(spark, 0, 0, 1), path)
    assert S.read_version(spark, path).count() == 0 and S.versions(spark, path) == [1, 2, 3]


def test_run_dates_and_pruning(spark):
    path = work_dir(spark, "t")
    S.commit_run_date(rows(spark, 0, 5, 1), path)
    for _ in range(2):
        S.commit_run_date(rows(spark, 3, 4, 50), path)
        assert content(S.read_version(spark, path)) == content(rows(spark, 0, 3, 1).union(rows(spark, 3, 4, 50)))
    one = S.read_version(spark, path, wanted=lambda d: d >= "2024-05-06")
    assert content(one) == content(rows(spark, 5, 2, 50)) and len(one.inputFiles()) < len(S.read_version(spark, path).inputFiles())
    with pytest.raises(ValueError):
        S.commit_run_date(rows(spark, 3, 1, 50).withColumn("more", F.lit(1)), path)


def test_upsert(spark):
    path = work_dir(spark, "t")
    S.commit_upsert(rows(spark, 0, 4, 1), path, ["series", "date"])
    before = S.version(spark, path)
    new = rows(spark, 2, 3, 100).filter("series = 's1'")
    S.commit_upsert(new, path, ["series", "date"])
    want = {(s, d): v for s, d, v in content(rows(spark, 0, 4, 1))} | {(s, d): v for s, d, v in content(new)}
    assert content(S.read_version(spark, path)) == sorted((*k, v) for k, v in want.items())
    after = S.version(spark, path)
    assert [p for p in before.folders if before.folders[p] == after.folders[p]] == ["2024-05-01", "2024-05-02"]  # untouched
    S.commit_upsert(rows(spark, 0, 1, -9), path, ["series", "date"], order=[F.col("value").desc()])
    assert content(S.read_version(spark, path)) == sorted((*k, v) for k, v in want.items())


def test_a_write_that_dies_leaves_the_version_before(spark, monkeypatch):
    path = work_dir(spark, "t")
    S.commit_run_date(rows(spark, 0, 2, 1), path)
    data = S._Files(spark, path).names(f"{path}/data")

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(S._Files, "create", dies)
    with pytest.raises(KeyboardInterrupt):  # after the rows, before the manifest
        S.commit_run_date(rows(spark, 0, 2, 7), path)
    monkeypatch.undo()
    assert S.versions(spark, path) == [1] and content(S.read_version(spark, path)) == content(rows(spark, 0, 2, 1))
    assert S._Files(spark, path).names(f"{path}/data") == data
    with pytest.raises(Exception, match="no such"):  # while the rows are written
        S.commit_run_date(rows(spark, 0, 2, 7).withColumn("value", F.when(F.col("value") > 0, F.raise_error(F.lit("no such"))).otherwise(F.col("value"))), path)
    assert content(S.read_version(spark, path)) == content(rows(spark, 0, 2, 1))
    S.commit_run_date(rows(spark, 0, 2, 8), path)
    assert content(S.read_version(spark, path)) == content(rows(spark, 0, 2, 8))


def test_two_writers(spark):
    path = work_dir(spark, "t")
    S.commit_run_date(rows(spark, 0, 4, 1), path)
    base = S.version(spark, path)
    S.commit_run_date(rows(spark, 0, 1, 10), path, base=base)
    S.commit_run_date(rows(spark, 2, 1, 20), path, base=base)  # other days: rebased
    with pytest.raises(S.VersionConflict):
        S.commit_upsert(rows(spark, 2, 1, 30), path, ["series", "date"], base=base)
    with pytest.raises(S.VersionConflict):
        S.commit_replace(rows(spark, 0, 1, 40), path, "date", base=base)
    want = rows(spark, 0, 1, 10).union(rows(spark, 1, 1, 1)).union(rows(spark, 2, 1, 20)).union(rows(spark, 3, 1, 1))
    assert content(S.read_version(spark, path)) == content(want) and S.versions(spark, path) == [1, 2, 3]
    files = S._Files(spark, path)
    assert not files.create(S._manifest(path, 3), "{}")  # a version is never written twice
    assert S.version(spark, path).number == 3 and not [n for n in files.names(f"{path}/versions") if n.endswith(".tmp")]


def test_expire(spark):
    path = work_dir(spark, "t")
    for k in range(4):
        S.commit_run_date(rows(spark, k, 1, k), path)
    S.commit_run_date(rows(spark, 0, 1, 77), path)
    whole = content(S.read_version(spark, path))
    S.expire(spark, path, keep=1)
    assert S.versions(spark, path) == [5] and content(S.read_version(spark, path)) == whole
