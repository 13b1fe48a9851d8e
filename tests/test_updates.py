"""Updates, upserts, deletes, validators and maintenance."""

import datetime as dt

import pytest

from tests.conftest import values
from vellum.errors import SpecError
from vellum.operators import maintenance, updates, validate


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "a", 5, [1, 2], 1.5), (2, "b", None, None, None), (3, "a", 7, [], 2.0)], "_id int, k string, n int, xs array<int>, f double")


def one(df, change, key=1, **kw):
    return {r["_id"]: r.asDict(True) for r in updates.update(df, {"_id": key}, change, True, **kw).collect()}[key]


@pytest.mark.parametrize(
    ("change", "key", "field", "want"),
    [
        ({"$set": {"k": "z"}}, 1, "k", "z"), ({"$set": {"d.e": 1}}, 1, "d", {"e": 1}), ({"$unset": {"k": 1}}, 1, "k", None),
        ({"$inc": {"n": 1.9}}, 1, "n", 6), ({"$inc": {"n": 2}}, 2, "n", 2), ({"$mul": {"n": 3}}, 1, "n", 15), ({"$mul": {"n": 3}}, 2, "n", 0), ({"$inc": {"f": 1}}, 1, "f", 2.5),
        ({"$min": {"n": 2}}, 1, "n", 2), ({"$max": {"n": 2}}, 1, "n", 5), ({"$min": {"n": 2}}, 2, "n", 2), ({"$rename": {"k": "j"}}, 1, "j", "a"),
        ({"$push": {"xs": 9}}, 1, "xs", [1, 2, 9]), ({"$push": {"xs": 9}}, 2, "xs", [9]), ({"$push": {"xs": {"$each": [7, 8], "$slice": 3}}}, 1, "xs", [1, 2, 7]), ({"$push": {"xs": {"$each": [7, 8], "$slice": -2}}}, 1, "xs", [7, 8]),
        ({"$pop": {"xs": 1}}, 1, "xs", [1]), ({"$pop": {"xs": -1}}, 1, "xs", [2]), ({"$pop": {"xs": 1}}, 3, "xs", []), ({"$addToSet": {"xs": {"$each": [2, 3]}}}, 1, "xs", [1, 2, 3]),
        ({"$pull": {"xs": 2}}, 1, "xs", [1]), ({"$pull": {"xs": {"$gte": 1}}}, 1, "xs", []), ({"k": "only"}, 1, "n", None), ({"$set": {"n": 1}, "$inc": {"n": 1}}, 1, "n", 2),
    ],
)
def test_operators(docs, change, key, field, want):
    assert one(docs, change, key)[field] == want


def test_other_rows_stay(docs):
    out = updates.update(docs, {"k": "a"}, {"$set": {"k": "z"}}, multi=False)
    assert values(out, "_id", "k") == [(1, "z"), (2, "b"), (3, "a")]


def test_upsert(docs):
    made = updates.update(docs, {"_id": 9, "k": "q"}, {"$inc": {"n": 4}, "$setOnInsert": {"f": 0.5}}, upsert=True)
    assert made.filter("_id = 9").first().asDict() == {"_id": 9, "k": "q", "n": 4, "xs": None, "f": 0.5}
    there = updates.update(docs, {"_id": 1}, {"$setOnInsert": {"f": 0.5}}, upsert=True)
    assert there.count() == 3 and there.filter("_id = 1").first()["f"] == 1.5


def test_delete_and_modify(docs):
    assert values(updates.delete(docs, {"k": "a"}), "_id") == [(2,)]
    assert values(updates.delete(docs, {"k": "a"}, multi=False), "_id") == [(2,), (3,)]
    after, value = updates.find_and_modify(docs, {"k": "a"}, {"n": -1}, {"$inc": {"n": 1}}, new=True)
    assert value.first()["n"] == 8 and after.filter("_id = 3").first()["n"] == 8 and after.filter("_id = 1").first()["n"] == 5
    after, value = updates.find_and_modify(docs, {"_id": 2}, remove=True)
    assert value.first()["_id"] == 2 and after.count() == 2


@pytest.mark.parametrize("change", [{"$nope": {"a": 1}}, {"$set": {"_id": 5}}, {"$set": {"n": "text"}}, {"$inc": {"n": "x"}}, {"$push": {"k": 1}}, {}])
def test_errors(docs, change):
    with pytest.raises(SpecError):
        updates.update(docs, {}, change, True)


def test_validator(spark):
    df = spark.createDataFrame([(1, "abc", 5, [1]), (2, None, 5, [1]), (3, "a", 5, [1]), (4, "abc", 50, [1]), (5, "abc", 5, [1, 2, 99]), (6, "xyz", 5, [])], "_id int, s string, n int, xs array<int>")
    schema = {"bsonType": "object", "required": ["s"], "properties": {"s": {"bsonType": "string", "minLength": 2, "pattern": "^a"}, "n": {"maximum": 10}, "xs": {"minItems": 1, "items": {"maximum": 10}}}}
    got = {r["_id"]: r["violation"] for r in validate.violations(df, {"$jsonSchema": schema}).collect()}
    assert got == {2: "required: s", 3: "minLength: s", 4: "maximum: n", 5: "items: xs", 6: "pattern: s"}
    assert values(validate.valid(df, schema), "_id") == [(1,)] and validate.valid(df, schema, "warn").count() == 6


def test_maintenance(spark):
    now = dt.datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([(1, now - dt.timedelta(seconds=61)), (2, now - dt.timedelta(seconds=60)), (3, None)], "_id int, at timestamp_ntz")
    assert values(maintenance.expire(df, "at", 60, now), "_id") == [(2,), (3,)]
    assert maintenance.expire(df, "at", 0, now).count() == 3
    rows = spark.range(100).withColumnRenamed("id", "_id")
    assert values(maintenance.capped(rows, max_docs=3), "_id") == [(97,), (98,), (99,)]
    assert values(maintenance.capped(rows, max_size=30), "_id") == [(97,), (98,), (99,)]
    dup = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "_id int, k string")
    assert values(maintenance.unique_violations(dup, ["k"], sparse=True)) == [("a", 2)]
    assert maintenance.unique_violations(dup, ["k"]).count() == 2
    tree = spark.createDataFrame([(1, ("x", None), [5, 6])], "_id int, d struct<a:string,b:int>, xs array<int>")
    assert values(maintenance.wildcard(tree)) == [("d.a", "x", 1), ("xs.0", "5", 1), ("xs.1", "6", 1)]
    assert maintenance.stats(spark.createDataFrame([], "_id int")).first()["avg_obj_size"] == 0
