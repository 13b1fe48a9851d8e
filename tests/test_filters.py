"""Filter semantics, above all of missing values, arrays and nested documents."""

import datetime as dt

import pytest

from tests.conftest import values
from vellum.errors import SpecError
from vellum.operators.find import count, distinct, find


@pytest.fixture(scope="module")
def missing(spark):
    return spark.createDataFrame([(1, 5, "x"), (2, None, "y"), (3, -7, None), (4, 0, "")], "_id int, a int, s string")


@pytest.fixture(scope="module")
def arrays(spark):
    return spark.createDataFrame(
        [(1, [1, 2, 2], [("a", 1), ("b", 5)]), (2, [], []), (3, None, None), (4, [3, None], [("a", 9)])],
        "_id int, xs array<int>, docs array<struct<k:string,v:int>>",
    )


@pytest.fixture(scope="module")
def nested(spark):
    return spark.createDataFrame([(1, ("Wien", (16.4, 48.2))), (2, ("Graz", None)), (3, None)], "_id int, addr struct<city:string,geo:struct<lon:double,lat:double>>")


def ids(df, spec):
    return sorted(r[0] for r in find(df, spec).select("_id").collect())


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        ({}, [1, 2, 3, 4]),
        ({"a": 5}, [1]),
        ({"a": None}, [2]),
        ({"a": {"$ne": 5}}, [2, 3, 4]),
        ({"a": {"$ne": None}}, [1, 3, 4]),
        ({"a": {"$gt": -10}}, [1, 3, 4]),
        ({"a": {"$not": {"$gt": 0}}}, [2, 3, 4]),
        ({"a": {"$in": [5, None]}}, [1, 2]),
        ({"a": {"$nin": [5]}}, [2, 3, 4]),
        ({"a": {"$nin": [None]}}, [1, 3, 4]),
        ({"$nor": [{"a": {"$gt": 0}}]}, [2, 3, 4]),
        ({"$or": [{"a": 5}, {"s": "y"}]}, [1, 2]),
        ({"$and": [{"a": {"$lt": 5}}, {"s": {"$exists": True}}]}, [4]),
        ({"$not": {"a": 5}}, [2, 3, 4]),
        ({"a": {"$exists": 1}}, [1, 3, 4]),
        ({"a": {"$exists": False}}, [2]),
        ({"b": {"$exists": False}}, [1, 2, 3, 4]),
        ({"a": "5"}, []),
        ({"a": {"$ne": "5"}}, [1, 2, 3, 4]),
        ({"s": {"$gt": 1}}, []),
        ({"a": {"$mod": [3, -1]}}, [3]),
        ({"a": {"$mod": [5.9, 0]}}, [1, 4]),
        ({"s": {"$regex": "^X$", "$options": "i"}}, [1]),
        ({"s": {"$regex": "("}}, []),
        ({"a": {"$regex": "5"}}, []),
        ({"a": {"$type": "int"}}, [1, 3, 4]),
        ({"a": {"$type": 16}}, [1, 3, 4]),
        ({"a": {"$type": ["string", "double"]}}, []),
        ({"$comment": "c", "a": {"$eq": 0}}, [4]),
    ],
)
def test_scalar(missing, spec, want):
    assert ids(missing, spec) == want


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        ({"xs": {"$size": 0}}, [2]),
        ({"xs": {"$size": 3}}, [1]),
        ({"xs": {"$all": [2, 1]}}, [1]),
        ({"xs": {"$all": []}}, [1, 2, 4]),
        ({"xs": {"$all": [None]}}, [4]),
        ({"xs": {"$in": [3]}}, [4]),
        ({"xs": {"$in": [[1, 2, 2]]}}, [1]),
        ({"xs": {"$nin": [1]}}, [2, 3, 4]),
        ({"xs": 1}, []),
        ({"xs": [1, 2, 2]}, [1]),
        ({"xs": []}, [2]),
        ({"xs.0": 1}, [1]),
        ({"docs": {"$elemMatch": {"k": "a", "v": {"$gt": 5}}}}, [4]),
        ({"docs": {"$not": {"$elemMatch": {"k": "a"}}}}, [2, 3]),
        ({"xs": {"$elemMatch": {"v": 1}}}, []),
    ],
)
def test_arrays(arrays, spec, want):
    assert ids(arrays, spec) == want


def test_nested(nested):
    assert ids(nested, {"addr.city": "Graz"}) == [2]
    assert ids(nested, {"addr.geo.lon": None}) == [2, 3]
    assert ids(nested, {"addr.nothing.x": None}) == [1, 2, 3]
    assert ids(nested, {"addr.geo": {"lon": 16.4, "lat": 48.2}}) == [1]
    assert ids(nested, {"addr.geo": {"lat": 48.2, "lon": 16.4}}) == []
    assert ids(nested, {"addr.geo": {"$near": {"$geometry": {"coordinates": [16.4, 48.2]}}}}) == [1]
    assert ids(nested, {"addr.geo": {"$geoWithin": {"$geometry": {"coordinates": [[[16, 48], [17, 48], [17, 49], [16, 48]]]}}}}) == [1]


@pytest.mark.parametrize("spec", [{"$where": "1"}, {"a": {"$foo": 1}}, {"a": {"$gt": 1, "b": 2}}, {"$or": []}, {"a": {"$mod": [0, 1]}}, {"a": {"$in": 3}}, {"a": {"$type": "nothing"}}, {"": 1}])
def test_errors(missing, spec):
    with pytest.raises(SpecError):
        find(missing, spec)


def test_text(spark):
    df = spark.createDataFrame([(1, "The running dogs"), (2, "a dog ran"), (3, None)], "_id int, t string")
    assert ids(df, {"$text": {"$search": "dog"}}) == [1, 2]
    assert ids(df, {"$text": {"$search": "Runs dogs the"}}) == [1]
    assert ids(df, {"$text": {"$search": "the of"}}) == [1, 2, 3]


def test_text_stems_few_words(spark, monkeypatch):
    import pyarrow as pa

    from vellum.functions import text

    df = spark.createDataFrame([(1, "The eyed FROM from fresh errs er " + "other words " * 50), (2, "eyes from er"), (3, None), (4, "from"), (5, "ers froms")], "_id int, s string")
    assert values(find(df, {"$text": {"$search": "that from er"}}), "_id") == [(1,), (2,), (5,)]
    assert values(find(df, {"$text": {"$search": "ei"}}), "_id") == [(1,)]  # the stem of eyed, which doesn't hold it
    seen = []
    monkeypatch.setattr(text, "porter_stems", lambda words: seen.append(words) or words)
    find(df, {"$text": {"$search": "that from er"}})
    # Only words that can have a wanted stem go to Python, each of them once a text.
    assert [r[0] for r in df.filter("_id < 4").orderBy("_id").select(seen[0]).collect()] == [["from", "fresh", "errs", "er"], ["from", "er"], []]
    words = pa.array([["zz"], ["cats", None, "cats"], None, [], ["ponies"]], pa.list_(pa.string()))
    assert text._porter_all.func(words.slice(1)).to_pylist() == [["cat", None, "cat"], None, [], ["poni"]]
    assert text._porter_all.func(words.slice(0, 0)).to_pylist() == []


def test_find_order_and_projection(missing, arrays):
    assert [r[0] for r in find(missing, sort={"a": 1}).collect()] == [2, 3, 4, 1]
    assert [r[0] for r in find(missing, sort={"a": -1}).collect()] == [1, 4, 3, 2]
    assert [r[0] for r in find(missing, sort={"a": 1}, missing="last").collect()] == [3, 4, 1, 2]
    assert [r[0] for r in find(missing, sort={"_id": -1}, skip=1, limit=2).collect()] == [3, 2]
    assert find(missing, limit=0).count() == 4
    assert find(missing, projection={"s": 1}).columns == ["_id", "s"]
    assert find(missing, projection={"_id": 0}).columns == ["a", "s"]
    assert find(missing, projection={"a": 1, "_id": 0}).columns == ["a"]
    with pytest.raises(SpecError):
        find(missing, projection={"a": 1, "s": 0})
    assert count(missing, {"a": {"$gte": 0}}).first()["n"] == 2
    assert sorted(r[0] for r in distinct(missing, "a").collect()) == [-7, 0, 5]
    assert {r[0] for r in distinct(arrays, "xs").collect()} == {1, 2, 3, None}


def test_pushdown(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, i % 7, dt.datetime(2020, 1, 1)) for i in range(50)], "_id int, a int, t timestamp").write.parquet(path)
    plan = find(spark.read.parquet(path), {"a": {"$gt": 2, "$ne": 5}, "_id": {"$in": [1, 2, 3]}}, {"a": 1})._jdf.queryExecution().toString()
    for wanted in ("GreaterThan(a,2)", "In(_id", "EqualNullSafe(a,5)"):
        assert wanted in plan
    assert "t:timestamp" not in plan.split("ReadSchema")[1]
