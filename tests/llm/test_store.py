"""Kept tables: marks, discards and releases; sizes of inputs without files; no machine-local folder on a cluster."""

import os

import pytest

from sievelake.llm import store


def there(df):
    return os.path.isdir(df.kept_at.removeprefix("file:"))


def test_discard_and_release(spark):
    begin = store.written()
    a, b, c = (store.materialize(spark.range(n), "t") for n in (1, 2, 3))
    assert store.written() == begin + 3 and there(a) and a.count() == 1
    store.discard(a)
    assert not there(a) and there(b) and store.written() == begin + 2
    store.release(begin, keep=1)
    assert not there(b) and there(c) and c.count() == 3
    store.release(begin)
    assert not there(c) and store.written() == begin


def test_groups_grow_with_inputs_that_have_no_files(spark):
    rows = spark.sparkContext.parallelize([("x" * 1000,)] * 5000, 4)
    df = spark.createDataFrame(rows, "text string")
    assert store.group_count(df, 10_000, 8) >= 500 and store.group_count(df.limit(0), 10_000, 8) == 8


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.shared_dir(Session())
