"""Stages, accumulators and expressions."""

import pytest

from tests.conftest import values
from vellum.errors import SpecError
from vellum.operators.stages import Context, aggregate


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([(1, "A", 100, "x"), (2, "B", 200, None), (3, "A", 50, "y"), (4, "A", None, "x")], "_id int, category string, amount int, tag string")


def test_group(sales):
    out = aggregate(sales, [{"$group": {"_id": "$category", "s": {"$sum": "$amount"}, "n": {"$sum": 1}, "c": {"$count": {}}, "avg": {"$avg": "$amount"}, "lo": {"$min": "$amount"}, "first": {"$first": "$amount"}, "last": {"$last": "$amount"}, "all": {"$push": "$tag"}, "set": {"$addToSet": "$tag"}}}])
    rows = {r["_id"]: r for r in out.collect()}
    assert (rows["A"]["s"], rows["A"]["n"], rows["A"]["c"], rows["A"]["avg"], rows["A"]["lo"]) == (150.0, 3, 3, 75.0, 50)
    assert (rows["A"]["first"], rows["A"]["last"]) == (100, None)
    assert rows["A"]["all"] == ["x", "y", "x"] and rows["A"]["set"] == ["x", "y"] and rows["B"]["all"] == [None]
    assert out.schema["n"].dataType.simpleString() == "int"
    down = aggregate(sales, [{"$sort": {"_id": -1}}, {"$group": {"_id": "$category", "f": {"$first": "$_id"}, "p": {"$push": "$_id"}}}])
    assert values(down) == [("A", 4, [4, 3, 1]), ("B", 2, [2])]
    mixed = aggregate(sales, [{"$sort": {"tag": 1, "_id": -1}}, {"$group": {"_id": None, "p": {"$push": "$_id"}}}])
    assert mixed.first()["p"] == [2, 4, 1, 3]


def test_group_keys(sales):
    both = aggregate(sales, [{"$group": {"_id": {"c": "$category", "t": "$tag"}, "n": {"$sum": 1}}}])
    assert {tuple(r) for r in both.select("_id.c", "_id.t", "n").collect()} == {("A", "x", 2), ("A", "y", 1), ("B", None, 1)}
    assert aggregate(sales.limit(0), [{"$group": {"_id": None, "n": {"$sum": 1}}}]).count() == 0
    assert aggregate(sales, [{"$group": {"_id": "$category"}}]).count() == 2
    assert aggregate(sales.limit(0), [{"$count": "n"}]).first()["n"] == 0


def test_lookup(spark):
    users = spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, None)], "_id int, name string")
    orders = spark.createDataFrame([(1, 1, 10), (2, 1, 20), (3, 2, 5), (4, None, 7)], "_id int, user_id int, amount int")
    ctx = Context(collection=lambda n: {"orders": orders, "users": users}[n])
    look = {"$lookup": {"from": "orders", "localField": "_id", "foreignField": "user_id", "as": "o"}}
    out = aggregate(users, [look], ctx)
    assert {r["_id"]: [x["amount"] for x in r["o"]] for r in out.collect()} == {1: [10, 20], 2: [5], 3: []}
    nulls = aggregate(users, [{"$lookup": {"from": "users", "localField": "name", "foreignField": "name", "as": "u"}}], ctx)
    assert {r["_id"]: len(r["u"]) for r in nulls.collect()} == {1: 1, 2: 1, 3: 1}
    fused = aggregate(users, [look, {"$unwind": "$o"}], ctx)
    assert values(fused.select("_id", "o.amount")) == [(1, 10), (1, 20), (2, 5)]
    assert "collect_list" not in fused._jdf.queryExecution().toString()
    kept = aggregate(users, [look, {"$unwind": {"path": "$o", "preserveNullAndEmptyArrays": True}}], ctx)
    assert kept.count() == 4 and kept.filter("o is null").count() == 1
    wrong = aggregate(users, [{"$lookup": {"from": "orders", "localField": "name", "foreignField": "user_id", "as": "o"}}], ctx)
    assert {len(r["o"]) for r in wrong.collect()} == {0}


def test_unwind(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, []), (3, None)], "_id int, tags array<string>")
    assert aggregate(df, [{"$unwind": "$tags"}]).count() == 3
    assert aggregate(df, [{"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True}}]).count() == 5
    assert aggregate(df, [{"$unwind": "$_id"}]).count() == 0


def test_expressions(spark):
    df = spark.createDataFrame([(1, 10.0, 5, "Ab", None), (2, 0.0, 0, "", True)], "_id int, price double, qty int, s string, b boolean")
    out = aggregate(
        df,
        [{"$project": {
            "m": {"$multiply": ["$price", "$qty"]}, "a": {"$add": ["$price", "$s", "$nothing", "$b"]}, "d": {"$divide": [1, "$qty"]}, "c": {"$concat": ["$s", "-", "$price", "$nothing"]},
            "u": {"$toUpper": "$s"}, "sub": {"$substr": ["$s", 1, -1]}, "cond": {"$cond": ["$qty", "yes", "no"]}, "n": {"$ifNull": ["$nothing", "$s"]}, "lit": {"$literal": "$s"},
        }}],
    ).orderBy("_id").collect()
    assert tuple(out[0]) == (1, 50.0, 10.0, 0.2, "Ab-10", "AB", "b", "yes", "Ab", "$s")
    assert tuple(out[1]) == (2, 0.0, 1.0, None, "-0", "", "", "no", "", "$s")


def test_shape(spark):
    df = spark.createDataFrame([(1, ("x", 2))], "_id int, d struct<a:string,b:int>")
    assert aggregate(df, [{"$project": {"d.a": 1}}]).first().asDict(True) == {"_id": 1, "d": {"a": "x"}}
    assert aggregate(df, [{"$project": {"d.b": 0}}]).first().asDict(True) == {"_id": 1, "d": {"a": "x"}}
    assert aggregate(df, [{"$set": {"d.c": "$d.b", "e.f": 1, "_id": 9}}]).first().asDict(True) == {"_id": 9, "d": {"a": "x", "b": 2, "c": 2}, "e": {"f": 1}}


@pytest.mark.parametrize("stages", [[{"$nope": 1}], [{"$limit": 0}], [{"$skip": -1}], [{"$group": {"x": {"$sum": 1}}}], [{"$match": {}, "$limit": 1}], [{"$project": {"a": {"$nope": 1}}}], [{"$sort": {"a": 2}}]])
def test_errors(sales, stages):
    with pytest.raises(SpecError):
        aggregate(sales, stages)


def test_topk_plan(sales):
    plan = aggregate(sales, [{"$sort": {"amount": -1}}, {"$skip": 1}, {"$limit": 2}])._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
