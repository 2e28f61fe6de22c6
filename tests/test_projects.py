"""The versioned table of projects: every operation, two writers, old versions."""

import pytest

from chromagrid.sources.projects import Conflict, Projects

SCHEMA = "id string, name string, at int"


def frame(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(p, version=None):
    return sorted(tuple(r) for r in p.rows(version).collect())


def test_operations_and_conflicts(spark, tmp_path):
    from pyspark.sql import functions as F

    p = Projects(spark, f"file://{tmp_path}/p", SCHEMA, buckets=4)
    assert held(p) == [] and p.versions() == [] and p.load("a").count() == 0
    assert p.save(frame(spark, ("a", "one", 1), ("b", "two", 1), ("c", "three", 1))) == 1
    assert p.save(frame(spark, ("b", "TWO", 2), ("d", "four", 2))) == 2
    assert held(p) == [("a", "one", 1), ("b", "TWO", 2), ("c", "three", 1), ("d", "four", 2)] and held(p, 1)[1] == ("b", "two", 1)
    assert [tuple(r) for r in p.load("b").collect()] == [("b", "TWO", 2)] and p.load("b", 1).first().name == "two"
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "id string")
    p.copy(spark.createDataFrame([("a", "e")], "id string, as string"), "as", name=F.concat("name", F.lit(" (copy)")))
    p.touch(keys("a", "zz"), "at", F.lit(9))
    p.delete(keys("c", "d"))
    assert held(p) == [("a", "one", 9), ("b", "TWO", 2), ("e", "one (copy)", 1)] and p.versions() == [1, 2, 3, 4, 5]
    # two writers begin from version 5
    assert p.save(frame(spark, ("x", "first", 3)), base=5) == 6
    with pytest.raises(Conflict, match="version 6"):
        p.save(frame(spark, ("y", "second", 3)), base=5)
    assert [r[0] for r in held(p)] == ["a", "b", "e", "x"]
    old = p._folders(5)[1]
    assert sum(old.get(b) == f for b, f in p._folders(6)[1].items()) >= len(old) - 1  # only the bucket of x is new
    p.vacuum()
    assert p.versions() == [6] and [r[0] for r in held(p)] == ["a", "b", "e", "x"]
    p.delete(keys("a", "b", "e", "x"))
    assert held(p) == []
