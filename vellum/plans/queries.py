"""Registered queries of the document engine, each with its SQL.

A query is a function of (spark, folder of tables); those with SQL are compared with DuckDB's result. Floats that depend on the
order of a sum are rounded on both sides.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.engine import Engine
from vellum.functions import geo, text, variant
from vellum.operators import find, maintenance, updates, validate
from vellum.operators.stages import Context, aggregate
from vellum.sources import backup, gridfs
from vellum.sources.scratch import folder
from vellum.streaming import changes, oplog

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def finds(name: str, table: str, filter: dict, columns: str, where: str, **options) -> None:
    """A find with a filter that is the SQL condition ``where``, and a projection of the columns."""
    projection = dict.fromkeys(columns.split(", "), 1)
    query(name, f"SELECT {columns} FROM {table} WHERE {where}")(lambda s, d: find.find(read(s, d, table), filter, projection, key=columns.split(", ")[0], **options))


def runs(name: str, table: str, pipeline: list[dict], sql: str, key: str | None = None, after: Callable[[DataFrame], DataFrame] | None = None, before: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """A pipeline over a table; ``after`` only flattens and rounds for the comparison."""

    def f(s: SparkSession, d: str) -> DataFrame:
        rows = read(s, d, table)
        rows = before(rows) if before else rows
        out = aggregate(rows, pipeline, Context(collection=lambda n: read(s, d, n), key=key or rows.columns[0]))
        return after(out) if after else out

    query(name, sql)(f)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(s: SparkSession, d: str) -> DataFrame:
    return _QUERIES["flagship"](s, d)


def rounded(df: DataFrame, *cols: str, to: int = 2) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in cols})


runs(
    "flagship",
    "orders",
    [
        {"$match": {"o_orderstatus": {"$in": ["F", "O"]}}},
        {"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "c"}},
        {"$unwind": "$c"},
        {"$group": {"_id": "$c.c_mktsegment", "total": {"$sum": "$o_totalprice"}, "n": {"$sum": 1}, "mean": {"$avg": "$o_totalprice"}}},
        {"$sort": {"total": -1}},
    ],
    "SELECT c_mktsegment AS _id, round(sum(o_totalprice), 2) AS total, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1",
    after=lambda df: rounded(df, "total", "mean"),
)

# --- filters ---------------------------------------------------------------------------------------------------------

finds("find_eq", "orders", {"o_orderstatus": "F"}, "o_orderkey, o_orderstatus", "o_orderstatus = 'F'")
finds("find_eq_operator", "orders", {"o_custkey": {"$eq": 7}}, "o_orderkey, o_custkey", "o_custkey = 7")
finds("find_ne", "orders", {"o_orderstatus": {"$ne": "F"}}, "o_orderkey, o_orderstatus", "o_orderstatus <> 'F'")
finds("find_range", "lineitem", {"l_quantity": {"$gte": 10, "$lt": 12}, "l_discount": {"$gt": 0.05}, "l_tax": {"$lte": 0.04}}, "l_orderkey, l_linenumber, l_quantity, l_discount", "l_quantity >= 10 AND l_quantity < 12 AND l_discount > 0.05 AND l_tax <= 0.04")
finds("find_range_date", "orders", {"o_orderdate": {"$gte": dt.datetime(1996, 1, 1), "$lt": dt.datetime(1996, 7, 1)}}, "o_orderkey, o_custkey", "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'")
finds("find_in", "orders", {"o_orderpriority": {"$in": ["1-URGENT", "5-LOW", None]}}, "o_orderkey, o_orderpriority", "o_orderpriority IN ('1-URGENT', '5-LOW') OR o_orderpriority IS NULL")
finds("find_nin", "orders", {"o_orderpriority": {"$nin": ["1-URGENT", "5-LOW"]}}, "o_orderkey, o_orderpriority", "o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
finds(
    "find_and_or_nor", "lineitem",
    {"$and": [{"l_returnflag": "R"}, {"$or": [{"l_quantity": {"$lt": 5}}, {"l_discount": {"$gt": 0.08}}]}], "$nor": [{"l_linestatus": "O"}, {"l_tax": 0.0}]},
    "l_orderkey, l_linenumber", "l_returnflag = 'R' AND (l_quantity < 5 OR l_discount > 0.08) AND NOT (l_linestatus = 'O' OR l_tax = 0.0)",
)
finds("find_not", "customer", {"c_acctbal": {"$not": {"$gt": 0}}, "$not": {"c_mktsegment": "BUILDING"}}, "c_custkey, c_acctbal", "NOT (c_acctbal > 0) AND NOT (c_mktsegment = 'BUILDING')")
finds("find_exists", "customer", {"c_name": {"$exists": True}, "c_fax": {"$exists": 0}}, "c_custkey, c_name", "c_name IS NOT NULL")
finds("find_type", "part", {"p_size": {"$type": ["int", "string"]}, "p_partkey": {"$type": "number"}, "p_name": {"$not": {"$type": 16}}}, "p_partkey, p_size", "true")
finds("find_regex", "part", {"p_type": {"$regex": "^(STANDARD|PROMO)"}}, "p_partkey, p_type", "regexp_matches(p_type, '^(STANDARD|PROMO)')")
finds("find_regex_options", "customer", {"c_mktsegment": {"$regex": "^b.*g$", "$options": "i"}}, "c_custkey, c_mktsegment", "regexp_matches(c_mktsegment, '^b.*g$', 'i')")
finds("find_mod", "orders", {"o_orderkey": {"$mod": [7, 3]}}, "o_orderkey, o_custkey", "o_orderkey % 7 = 3")
finds("find_expr", "orders", {"$expr": {"$gt": [{"$multiply": ["$o_totalprice", 2]}, 500000]}}, "o_orderkey, o_totalprice", "o_totalprice * 2 > 500000")
finds("find_comment", "nation", {"$comment": "all of a region", "n_regionkey": 1}, "n_nationkey, n_name", "n_regionkey = 1")


def _order_lines(s: SparkSession, d: str) -> DataFrame:
    """Orders with arrays of their lines: documents with nested data."""
    lines = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("numbers"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_quantity"))).alias("lines"))
    return lines.withColumnRenamed("l_orderkey", "_id")


query("find_size", "SELECT l_orderkey AS _id FROM lineitem GROUP BY 1 HAVING count(*) = 3")(lambda s, d: find.find(_order_lines(s, d), {"numbers": {"$size": 3}}, {"_id": 1}))
query("find_all", "SELECT l_orderkey AS _id FROM lineitem GROUP BY 1 HAVING bool_or(l_linenumber = 2) AND bool_or(l_linenumber = 5)")(lambda s, d: find.find(_order_lines(s, d), {"numbers": {"$all": [2, 5]}}, {"_id": 1}))
query("find_in_array", "SELECT l_orderkey AS _id FROM lineitem GROUP BY 1 HAVING bool_or(l_linenumber IN (6, 7))")(lambda s, d: find.find(_order_lines(s, d), {"numbers": {"$in": [6, 7, "x"]}}, {"_id": 1}))
query("find_elem_match", "SELECT l_orderkey AS _id FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R' AND l_quantity > 45)")(lambda s, d: find.find(_order_lines(s, d), {"lines": {"$elemMatch": {"l_returnflag": "R", "l_quantity": {"$gt": 45}}}}, {"_id": 1}))
query("find_vector_size", "SELECT vec_id, label FROM embeddings WHERE len(embedding) = 64")(lambda s, d: find.find(read(s, d, "embeddings"), {"embedding": {"$size": 64}}, {"vec_id": 1, "label": 1}, key="vec_id"))


def _props(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").withColumn("props", F.from_json("props", "k bigint"))


query("find_dotted", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")(
    lambda s, d: find.find(_props(s, d), {"props.k": {"$gte": 50}}, {"event_id": 1, "props.k": 1}, key="event_id").select("event_id", F.col("props.k").alias("k"))
)
query("find_sort_skip_limit", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")(
    lambda s, d: find.find(read(s, d, "orders"), {"o_orderstatus": "O"}, {"o_orderkey": 1, "o_totalprice": 1}, {"o_totalprice": -1, "o_orderkey": 1}, 10, 20, key="o_orderkey")
)
query("find_project_incl", "SELECT n_nationkey, n_name FROM nation")(lambda s, d: find.find(read(s, d, "nation"), None, {"n_name": 1}, key="n_nationkey"))
query("find_project_excl", "SELECT n_name, n_regionkey FROM nation")(lambda s, d: find.find(read(s, d, "nation"), None, {"n_nationkey": 0}, key="n_nationkey"))
query("find_one", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) ORDER BY o_orderkey LIMIT 1")(
    lambda s, d: find.find(read(s, d, "orders"), {}, {"o_orderkey": 1, "o_custkey": 1}, {"o_custkey": 1, "o_orderkey": 1}, limit=1, key="o_orderkey")
)
query("count_filter", "SELECT CAST(count(*) AS INTEGER) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01'")(lambda s, d: find.count(read(s, d, "lineitem"), {"l_shipdate": {"$gte": dt.datetime(1997, 1, 1)}}))
query("distinct_scalar", "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderstatus = 'P'")(lambda s, d: find.distinct(read(s, d, "orders"), "o_orderpriority", {"o_orderstatus": "P"}))
query("distinct_array_flatten", "SELECT DISTINCT l_linenumber AS value FROM lineitem")(lambda s, d: find.distinct(_order_lines(s, d), "numbers"))
query("distinct_nested", "SELECT DISTINCT CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events")(lambda s, d: find.distinct(_props(s, d), "props.k"))

# --- aggregation -----------------------------------------------------------------------------------------------------

runs(
    "agg_group_sum", "lineitem",
    [{"$group": {"_id": "$l_returnflag", "qty": {"$sum": "$l_quantity"}, "net": {"$sum": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}}, "n": {"$sum": 1}, "twice": {"$sum": 2}}}],
    "SELECT l_returnflag AS _id, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 1) AS net, CAST(count(*) AS INTEGER) AS n, CAST(2 * count(*) AS INTEGER) AS twice FROM lineitem GROUP BY 1",
    after=lambda df: rounded(df, "net", to=1),
)
runs("agg_group_avg", "lineitem", [{"$group": {"_id": "$l_linestatus", "mean": {"$avg": "$l_extendedprice"}}}], "SELECT l_linestatus AS _id, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1", after=lambda df: rounded(df, "mean", to=4))
runs("agg_group_minmax", "orders", [{"$group": {"_id": "$o_orderpriority", "lo": {"$min": "$o_totalprice"}, "hi": {"$max": "$o_orderdate"}, "name": {"$max": "$o_orderstatus"}}}], "SELECT o_orderpriority AS _id, min(o_totalprice) AS lo, max(o_orderdate) AS hi, max(o_orderstatus) AS name FROM orders GROUP BY 1")
runs("agg_group_count", "orders", [{"$group": {"_id": "$o_orderstatus", "n": {"$count": {}}}}], "SELECT o_orderstatus AS _id, CAST(count(*) AS INTEGER) AS n FROM orders GROUP BY 1")
runs(
    "agg_group_first_last", "orders",
    [{"$sort": {"o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "first": {"$first": "$o_orderkey"}, "last": {"$last": "$o_totalprice"}}}],
    "SELECT o_custkey AS _id, arg_min(o_orderkey, o_orderkey) AS first, arg_max(o_totalprice, o_orderkey) AS last FROM orders GROUP BY 1",
)
runs(
    "agg_group_first_mixed_sort", "orders",
    [{"$sort": {"o_orderstatus": 1, "o_orderkey": -1}}, {"$group": {"_id": "$o_custkey", "first": {"$first": "$o_orderkey"}}}],
    "SELECT o_custkey AS _id, o_orderkey AS first FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey DESC) AS r FROM orders) WHERE r = 1",
)
runs(
    "agg_group_push", "lineitem",
    [{"$sort": {"l_linenumber": 1}}, {"$group": {"_id": "$l_orderkey", "parts": {"$push": "$l_partkey"}}}],
    "SELECT l_orderkey AS _id, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1",
    before=lambda df: df.withColumn("l_linenumber", F.col("l_linenumber") * F.lit(1000000000).cast("long") + F.col("l_partkey")),
    after=lambda df: df.withColumn("parts", F.array_join(F.col("parts").cast("array<string>"), ",")),
)
runs(
    "agg_group_add_to_set", "orders",
    [{"$group": {"_id": "$o_custkey", "states": {"$addToSet": "$o_orderstatus"}}}],
    "SELECT o_custkey AS _id, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS states FROM orders GROUP BY 1",
    after=lambda df: df.withColumn("states", F.array_join("states", ",")),
)
runs(
    "agg_group_compound_id", "lineitem",
    [{"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "n": {"$sum": 1}}}],
    "SELECT l_returnflag AS flag, l_linestatus AS status, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY 1, 2",
    after=lambda df: df.select("_id.flag", "_id.status", "n"),
)
runs("agg_group_null_id", "orders", [{"$group": {"_id": None, "n": {"$sum": 1}, "hi": {"$max": "$o_totalprice"}}}], "SELECT CAST(count(*) AS INTEGER) AS n, max(o_totalprice) AS hi FROM orders", after=lambda df: df.drop("_id"))
runs("agg_having", "orders", [{"$group": {"_id": "$o_custkey", "n": {"$sum": 1}}}, {"$match": {"n": {"$gte": 15}}}], "SELECT o_custkey AS _id, CAST(count(*) AS INTEGER) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
runs("agg_count_stage", "events", [{"$match": {"event_type": "error"}}, {"$count": "n"}], "SELECT CAST(count(*) AS INTEGER) AS n FROM events WHERE event_type = 'error'")
runs("agg_count_empty", "events", [{"$match": {"event_type": "nothing"}}, {"$count": "n"}], "SELECT CAST(0 AS INTEGER) AS n")
runs(
    "agg_lookup", "customer",
    [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "orders"}}, {"$project": {"c_custkey": 1, "orders": 1}}],
    "SELECT c_custkey, CAST(count(o_orderkey) AS INTEGER) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    after=lambda df: df.select("c_custkey", F.size("orders").alias("n"), F.array_join(F.array_sort(F.col("orders.o_orderkey")).cast("array<string>"), ",").alias("keys")),
)
runs(
    "agg_lookup_unwind", "orders",
    [{"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "c"}}, {"$unwind": "$c"}, {"$project": {"o_orderkey": 1, "segment": "$c.c_mktsegment"}}],
    "SELECT o_orderkey, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey",
)
runs(
    "agg_lookup_unwind_preserve", "customer",
    [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$unwind": {"path": "$o", "preserveNullAndEmptyArrays": True}}, {"$project": {"c_custkey": 1, "o_orderkey": "$o.o_orderkey"}}],
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
)
runs(
    "agg_lookup_chain", "nation",
    [
        {"$lookup": {"from": "region", "localField": "n_regionkey", "foreignField": "r_regionkey", "as": "r"}}, {"$unwind": "$r"},
        {"$lookup": {"from": "customer", "localField": "n_nationkey", "foreignField": "c_nationkey", "as": "c"}}, {"$unwind": "$c"},
        {"$group": {"_id": "$r.r_name", "n": {"$sum": 1}}}, {"$sort": {"_id": 1}},
    ],
    "SELECT r_name AS _id, CAST(count(*) AS INTEGER) AS n FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON n_nationkey = c_nationkey GROUP BY 1",
)
query("agg_unwind", "SELECT l_orderkey AS _id, l_linenumber AS numbers FROM lineitem")(lambda s, d: aggregate(_order_lines(s, d), [{"$unwind": "$numbers"}, {"$project": {"numbers": 1}}]))
query("agg_unwind_preserve", "SELECT c_custkey AS _id, o_orderkey AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey")(
    lambda s, d: aggregate(
        read(s, d, "customer").select(F.col("c_custkey").alias("_id")).join(read(s, d, "orders").groupBy(F.col("o_custkey").alias("_id")).agg(F.collect_list("o_orderkey").alias("keys")), "_id", "left"),
        [{"$unwind": {"path": "$keys", "preserveNullAndEmptyArrays": True}}],
    )
)
runs("agg_addfields", "part", [{"$addFields": {"price2": {"$multiply": ["$p_retailprice", 2]}, "size1": {"$add": ["$p_size", 1]}, "p_size": {"$literal": 0}}}, {"$project": {"price2": 1, "size1": 1, "p_size": 1}}], "SELECT p_partkey, round(p_retailprice * 2, 4) AS price2, CAST(p_size + 1 AS DOUBLE) AS size1, 0 AS p_size FROM part", after=lambda df: rounded(df, "price2", to=4))
runs("agg_set_nested", "customer", [{"$set": {"info.bal": "$c_acctbal", "info.name": {"$toLower": "$c_name"}}}, {"$project": {"c_custkey": 1, "b": "$info.bal", "n": "$info.name"}}], "SELECT c_custkey, c_acctbal AS b, lower(c_name) AS n FROM customer")
runs("agg_project_expr", "lineitem", [{"$project": {"l_linenumber": 1, "charge": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}, {"$add": [1, "$l_tax"]}]}}}], "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem", after=lambda df: rounded(df, "charge", to=6))
runs("agg_project_excl", "supplier", [{"$project": {"s_name": 0, "s_nationkey": False}}], "SELECT s_suppkey, s_acctbal FROM supplier")
runs("agg_sort_topk", "lineitem", [{"$sort": {"l_extendedprice": -1, "l_orderkey": 1, "l_linenumber": 1}}, {"$limit": 25}, {"$project": {"l_linenumber": 1, "l_extendedprice": 1}}], "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
runs("agg_skip_limit", "orders", [{"$sort": {"o_orderkey": 1}}, {"$skip": 100}, {"$limit": 50}, {"$project": {"o_orderkey": 1}}], "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
runs("agg_bench_regions", "events", [{"$group": {"_id": "$event_type", "total": {"$sum": "$value"}}}], "SELECT event_type AS _id, round(sum(value), 2) AS total FROM events GROUP BY 1", after=lambda df: rounded(df, "total"))

# --- expressions -----------------------------------------------------------------------------------------------------

runs("expr_arith", "part", [{"$project": {"a": {"$add": ["$p_size", "$p_retailprice", 1]}, "b": {"$subtract": ["$p_retailprice", "$p_size"]}, "c": {"$multiply": ["$p_size", 3]}, "d": {"$divide": ["$p_retailprice", 4]}, "e": {"$add": ["$p_size", "$p_name"]}, "f": {"$subtract": ["$p_size"]}}}], "SELECT p_partkey, round(p_size + p_retailprice + 1, 4) AS a, round(p_retailprice - p_size, 4) AS b, p_size * 3.0::DOUBLE AS c, round(p_retailprice / 4, 4) AS d, CAST(p_size AS DOUBLE) AS e, 0 AS f FROM part", after=lambda df: rounded(df, "a", "b", "d", to=4))
runs("expr_divide_zero", "part", [{"$project": {"q": {"$divide": ["$p_retailprice", {"$subtract": ["$p_size", 10]}]}}}], "SELECT p_partkey, CASE WHEN p_size <> 10 THEN round(p_retailprice / (p_size - 10), 4) END AS q FROM part", after=lambda df: rounded(df, "q", to=4))
runs("expr_concat", "part", [{"$project": {"s": {"$concat": ["$p_brand", "/", "$p_size", "/", "$p_missing", "$p_name"]}}}], "SELECT p_partkey, p_brand || '/' || CAST(p_size AS VARCHAR) || '/' || p_name AS s FROM part")
runs("expr_case_conv", "part", [{"$project": {"lo": {"$toLower": "$p_type"}, "up": {"$toUpper": "$p_name"}, "no": {"$toUpper": "$p_size"}}}], "SELECT p_partkey, lower(p_type) AS lo, upper(p_name) AS up, CAST(NULL AS VARCHAR) AS no FROM part")
runs("expr_substr", "part", [{"$project": {"a": {"$substr": ["$p_type", 2, 5]}, "b": {"$substr": ["$p_type", 3, -1]}, "c": {"$substr": ["$p_type", -4, 2]}, "d": {"$substr": ["$p_size", 0, 2]}}}], "SELECT p_partkey, substring(p_type, 3, 5) AS a, substring(p_type, 4) AS b, substring(p_type, 1, 2) AS c, '' AS d FROM part")
runs("expr_cond", "part", [{"$project": {"a": {"$cond": [{"$subtract": ["$p_size", 10]}, "other", "ten"]}, "b": {"$cond": ["$p_name", "$p_size", 0.5]}, "c": {"$cond": {"if": {"$gt": ["$p_size", 25]}, "then": "big", "else": "small"}}}}], "SELECT p_partkey, CASE WHEN p_size <> 10 THEN 'other' ELSE 'ten' END AS a, CASE WHEN p_name <> '' THEN CAST(p_size AS DOUBLE) ELSE 0.5 END AS b, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS c FROM part")
runs("expr_ifnull", "part", [{"$project": {"a": {"$ifNull": ["$p_missing", "$p_brand"]}, "b": {"$ifNull": ["$p_size", -1]}}}], "SELECT p_partkey, p_brand AS a, p_size AS b FROM part")
runs("expr_date_parts", "orders", [{"$group": {"_id": {"$year": "$o_orderdate"}, "n": {"$sum": 1}}}], "SELECT CAST(year(o_orderdate) AS INTEGER) AS _id, CAST(count(*) AS INTEGER) AS n FROM orders GROUP BY 1")

# --- updates ---------------------------------------------------------------------------------------------------------


def upd(name: str, change: dict, columns: str, sql: str, filter: dict | None = None, multi: bool = True, **options) -> None:
    def f(s: SparkSession, d: str) -> DataFrame:
        out = updates.update(read(s, d, "customer"), filter or {"c_mktsegment": "BUILDING"}, change, multi, key="c_custkey", **options)
        return out.selectExpr(*columns.split("; "))

    query(name, sql)(f)


_B = "c_mktsegment = 'BUILDING'"
upd("upd_set", {"$set": {"c_name": "x", "c_note.text": "vip"}}, "c_custkey; c_name; c_note.text AS note", f"SELECT c_custkey, CASE WHEN {_B} THEN 'x' ELSE c_name END AS c_name, CASE WHEN {_B} THEN 'vip' END AS note FROM customer")
upd("upd_unset", {"$unset": {"c_acctbal": ""}}, "c_custkey; c_acctbal", f"SELECT c_custkey, CASE WHEN NOT {_B} THEN c_acctbal END AS c_acctbal FROM customer")
upd("upd_inc", {"$inc": {"c_nationkey": 2.9, "c_visits": 3}}, "c_custkey; c_nationkey; c_visits", f"SELECT c_custkey, CASE WHEN {_B} THEN c_nationkey + 2 ELSE c_nationkey END AS c_nationkey, CASE WHEN {_B} THEN 3 END AS c_visits FROM customer")
upd("upd_mul", {"$mul": {"c_acctbal": 2, "c_visits": 5}}, "c_custkey; round(c_acctbal, 4) AS c_acctbal; c_visits", f"SELECT c_custkey, round(CASE WHEN {_B} THEN c_acctbal * 2 ELSE c_acctbal END, 4) AS c_acctbal, CASE WHEN {_B} THEN 0 END AS c_visits FROM customer")
upd("upd_min", {"$min": {"c_acctbal": 100.0}}, "c_custkey; c_acctbal", f"SELECT c_custkey, CASE WHEN {_B} THEN least(c_acctbal, 100.0) ELSE c_acctbal END AS c_acctbal FROM customer")
upd("upd_max", {"$max": {"c_acctbal": 100.0}}, "c_custkey; c_acctbal", f"SELECT c_custkey, CASE WHEN {_B} THEN greatest(c_acctbal, 100.0) ELSE c_acctbal END AS c_acctbal FROM customer")
upd("upd_rename", {"$rename": {"c_name": "c_title"}}, "c_custkey; c_name; c_title", f"SELECT c_custkey, CASE WHEN NOT {_B} THEN c_name END AS c_name, CASE WHEN {_B} THEN c_name END AS c_title FROM customer")
upd("upd_replace", {"c_name": "new", "c_acctbal": 1.0}, "c_custkey; c_name; c_nationkey; c_acctbal; c_mktsegment", f"SELECT c_custkey, CASE WHEN {_B} THEN 'new' ELSE c_name END AS c_name, CASE WHEN NOT {_B} THEN c_nationkey END AS c_nationkey, CASE WHEN {_B} THEN 1.0::DOUBLE ELSE c_acctbal END AS c_acctbal, CASE WHEN NOT {_B} THEN c_mktsegment END AS c_mktsegment FROM customer")
upd("upd_first_only", {"$set": {"c_name": "x"}}, "c_custkey; c_name", f"SELECT c_custkey, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer WHERE {_B}) THEN 'x' ELSE c_name END AS c_name FROM customer", multi=False)
upd("upd_current_date", {"$currentDate": {"c_seen": True}}, "c_custkey; CAST(c_seen AS timestamp_ntz) AS c_seen", f"SELECT c_custkey, CASE WHEN {_B} THEN TIMESTAMP '2024-05-01 12:00:00' END AS c_seen FROM customer", now=dt.datetime(2024, 5, 1, 12))
upd("upd_upsert", {"$set": {"c_name": "made"}, "$setOnInsert": {"c_acctbal": 5.0}}, "c_custkey; c_name; c_acctbal; c_mktsegment", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT -1, 'made', 5.0, 'NOWHERE'", filter={"c_custkey": -1, "c_mktsegment": "NOWHERE"}, upsert=True)
upd("upd_upsert_matched", {"$set": {"c_name": "made"}, "$setOnInsert": {"c_acctbal": 5.0}}, "c_custkey; c_name; c_acctbal", "SELECT c_custkey, CASE WHEN c_custkey = 3 THEN 'made' ELSE c_name END AS c_name, c_acctbal FROM customer", filter={"c_custkey": 3}, upsert=True)


def upd_array(name: str, change: dict, sql: str) -> None:
    def f(s: SparkSession, d: str) -> DataFrame:
        out = updates.update(_order_lines(s, d).drop("lines"), {"_id": {"$mod": [2, 0]}}, change, True)
        return out.select("_id", F.array_join(F.col("numbers").cast("array<string>"), ",").alias("numbers"))

    base = "SELECT l_orderkey AS _id, list(l_linenumber ORDER BY l_linenumber) AS a FROM lineitem GROUP BY 1"
    query(name, f"SELECT _id, array_to_string(CASE WHEN _id % 2 = 0 THEN {sql} ELSE a END, ',') AS numbers FROM ({base})")(f)


upd_array("upd_push", {"$push": {"numbers": 99}}, "list_append(a, 99)")
upd_array("upd_push_each_slice", {"$push": {"numbers": {"$each": [98, 99], "$slice": -3}}}, "list_concat(a, [98, 99])[-3:]")
upd_array("upd_pop", {"$pop": {"numbers": 1}}, "a[1:len(a)-1]")
upd_array("upd_pop_first", {"$pop": {"numbers": -1}}, "a[2:]")
upd_array("upd_add_to_set", {"$addToSet": {"numbers": {"$each": [1, 42]}}}, "list_append(CASE WHEN list_contains(a, 1) THEN a ELSE list_append(a, 1) END, 42)")
upd_array("upd_pull", {"$pull": {"numbers": {"$gt": 3}}}, "list_filter(a, lambda x: NOT x > 3)")
query("delete_many", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 100000)")(lambda s, d: updates.delete(read(s, d, "orders"), {"o_orderstatus": "F", "o_totalprice": {"$lt": 100000}}, key="o_orderkey").select("o_orderkey"))
query("delete_one", "SELECT o_orderkey FROM orders WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'F')")(lambda s, d: updates.delete(read(s, d, "orders"), {"o_orderstatus": "F"}, multi=False, key="o_orderkey").select("o_orderkey"))
query("find_and_modify", "SELECT c_custkey, c_acctbal + 10 AS c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 1")(
    lambda s, d: updates.find_and_modify(read(s, d, "customer"), {"c_mktsegment": "BUILDING"}, {"c_acctbal": -1}, {"$inc": {"c_acctbal": 10}}, new=True, fields={"c_custkey": 1, "c_acctbal": 1}, key="c_custkey")[1]
)
query("insert_overwrites", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey >= 5 UNION ALL SELECT n_nationkey, 'x', n_regionkey FROM nation WHERE n_nationkey < 5")(
    lambda s, d: updates.insert(read(s, d, "nation"), read(s, d, "nation").filter("n_nationkey < 5").withColumn("n_name", F.lit("x")), "n_nationkey")
)

query("insert_batch_repeats", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey >= 5 UNION ALL SELECT n_nationkey, 'y', n_regionkey FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey + 100, 'y', n_regionkey FROM nation WHERE n_nationkey < 3")(
    lambda s, d: updates.insert(read(s, d, "nation"), _batch(s, d, "x").unionByName(_batch(s, d, "y")), "n_nationkey")
)


def _batch(s: SparkSession, d: str, name: str) -> DataFrame:
    """Some nations, known and new, under another name."""
    n = read(s, d, "nation").withColumn("n_name", F.lit(name))
    return n.filter("n_nationkey < 5").unionByName(n.filter("n_nationkey < 3").withColumn("n_nationkey", (F.col("n_nationkey") + 100).cast("int")))


# --- text and geo ----------------------------------------------------------------------------------------------------

# Words whose stem is the query's: all spellings that the suffix rules can bring to it.
_ENDINGS = ("", "s", "es", "ed", "eds", "ing", "ings", "er", "ers", "ance", "ances", "ence", "ic", "able", "ible", "ant", "ants", "ement", "ment", "ments", "ent", "ou", "ism", "isms", "ate", "ates", "ated", "iti", "ity", "ous", "ive", "ives", "ize", "izes", "ized", "al", "als", "e", "ly", "li", "ational", "ation", "ations", "alize", "icate", "ative", "iciti", "ical", "ful", "ness", "iveness", "fulness", "ousness")


def _stem_words(stem: str) -> str:
    """A SQL list of the words with this stem."""
    return ", ".join(f"'{stem + e}'" for e in _ENDINGS if text.porter(stem + e) == stem)


query(
    "text_match_all",
    f"SELECT doc_id FROM (SELECT doc_id, list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM documents) WHERE list_has_any(w, [{_stem_words('from')}]) AND list_has_any(w, [{_stem_words('er')}])",
)(lambda s, d: find.find(read(s, d, "documents").select("doc_id", "text"), {"$text": {"$search": "that from er"}}, {"doc_id": 1}, key="doc_id"))
_T = "(SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM documents)"
query(
    "text_tfidf",
    f"""WITH t AS (SELECT doc_id, CASE WHEN w IN ('er', 'ers', 'ering', 'ered') THEN 'er' ELSE 'thand' END AS term FROM {_T} WHERE w IN ('er', 'ers', 'ering', 'ered', 'thand', 'thands', 'thanding', 'thanded')),
    s AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
    f AS (SELECT term, count(*) AS df FROM s GROUP BY 1)
    SELECT doc_id, round(sum(tf * (ln((SELECT count(*) FROM documents) / df) + 1)), 4) AS score FROM s JOIN f USING (term) GROUP BY 1""",
)(lambda s, d: rounded(text.search(read(s, d, "documents"), "doc_id", "text", "thand ering"), "score", to=4))
query("text_postings", f"SELECT w AS term, count(*) AS n FROM {_T} WHERE w IN ('that', 'from', 'ea') GROUP BY 1")(
    lambda s, d: text.postings(read(s, d, "documents"), "doc_id", "text", stem=lambda w: w).filter(F.col("term").isin("that", "from", "ea")).groupBy("term").agg(F.sum("tf").alias("n"))
)
_WORDS = "(SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_type || ' ' || p_name || ' ' || p_type), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM part)"
query("text_positions", f"SELECT p_partkey AS key, w AS term, count(*) AS tf, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS positions FROM (SELECT p_partkey, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM {_WORDS}) GROUP BY 1, 2")(
    lambda s, d: text.postings(read(s, d, "part").withColumn("t", F.concat_ws(" ", "p_type", "p_name", "p_type")), "p_partkey", "t", stem=lambda w: w).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))
)
_PORTER = "economy standard large medium small promo relational conditional valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner adjustable replacement adoption caresses ponies cats agreed plastered motoring hopping tanned falling hissing fizzed failing filing happy sky relate controll roll"


def _porter_sql() -> str:
    """Stems by rules of their own in SQL for the plural and the participles of short stems; the others are listed."""
    stems = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "failing": "fail", "filing": "file", "happy": "happi", "hopeful": "hope", "goodness": "good", "roll": "roll", "economy": "economi", "small": "small", "large": "larg", "promo": "promo"}
    return "SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{x}')" for w, x in stems.items()) + ") AS t(word, stem)"


query("text_porter", _porter_sql())(
    lambda s, d: s.createDataFrame([(_PORTER,)], "t string").select(F.explode(F.arrays_zip(F.split("t", " ").alias("word"), text.porter_stems(F.split("t", " ")).alias("stem"))).alias("z")).select("z.word", "z.stem")
    .filter(F.col("word").isin(*"caresses ponies cats agreed plastered motoring hopping falling failing filing happy hopeful goodness roll economy small large promo".split()))
)
query(
    "text_prefix_tfidf",
    """WITH w AS (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_type || ' ' || p_name), '[^a-z0-9]+')) AS t FROM part),
    s AS (SELECT p_partkey, CASE t WHEN 'economy' THEN 'economi' WHEN 'large' THEN 'larg' ELSE t END AS term FROM w WHERE length(t) > 1),
    n AS (SELECT p_partkey, count(*) AS n FROM s GROUP BY 1),
    f AS (SELECT p_partkey, term, count(*) AS c FROM s GROUP BY 1, 2)
    SELECT p_partkey, round(c / n * ln(1000.0 / ((SELECT count(*) FROM f WHERE starts_with(term, 'larg')) + 1)), 6) AS score FROM f JOIN n USING (p_partkey) WHERE term = 'larg'""",
)(lambda s, d: rounded(text.prefix_tfidf(read(s, d, "part"), "p_partkey", ["p_type", "p_name"], "large"), "score", to=6))
query("text_snippet", "SELECT p_partkey, CASE WHEN instr(lower(p_type || ' / ' || p_name), 'ring') > 0 THEN (CASE WHEN instr(lower(p_type || ' / ' || p_name), 'ring') - 1 > 4 THEN '...' ELSE '' END) || substring(p_type || ' / ' || p_name, greatest(instr(lower(p_type || ' / ' || p_name), 'ring') - 5, 0) + 1, least(length(p_type || ' / ' || p_name), instr(lower(p_type || ' / ' || p_name), 'ring') - 1 + 6) - greatest(instr(lower(p_type || ' / ' || p_name), 'ring') - 5, 0)) || (CASE WHEN least(length(p_type || ' / ' || p_name), instr(lower(p_type || ' / ' || p_name), 'ring') + 5) < length(p_type || ' / ' || p_name) THEN '...' ELSE '' END) ELSE p_type || ' / ' || p_name END AS snippet FROM part")(
    lambda s, d: read(s, d, "part").select("p_partkey", text.snippet(F.concat_ws(" / ", "p_type", "p_name"), "ring", 4, 6).alias("snippet"))
)


def _places(s: SparkSession, d: str) -> DataFrame:
    """Customers with made-up points."""
    lon, lat = (F.col("c_custkey") * 7919 % 36000) / 100.0 - 180.0, (F.col("c_custkey") * 104729 % 17000) / 100.0 - 85.0
    return read(s, d, "customer").select("c_custkey", F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("loc"))


_P = "(SELECT c_custkey, (c_custkey * 7919 % 36000) / 100.0 - 180.0 AS lon, (c_custkey * 104729 % 17000) / 100.0 - 85.0 AS lat FROM customer)"
_D = "2 * 6371000 * atan2(sqrt(h), sqrt(1 - h))"
_H = "pow(sin(radians(lat - 48.2) / 2), 2) + cos(radians(48.2)) * cos(radians(lat)) * pow(sin(radians(lon - 16.4) / 2), 2)"
query("geo_near", f"SELECT c_custkey FROM (SELECT *, {_H} AS h FROM {_P}) WHERE {_D} <= 2000000")(
    lambda s, d: find.find(_places(s, d), {"loc": {"$near": {"$geometry": {"type": "Point", "coordinates": [16.4, 48.2]}, "$maxDistance": 2000000}}}, {"c_custkey": 1}, key="c_custkey")
)
query("geo_near_sphere", f"SELECT c_custkey FROM (SELECT *, {_H} AS h FROM {_P}) WHERE {_D} <= 3000000")(
    lambda s, d: find.find(_places(s, d), {"loc": {"$nearSphere": {"$geometry": {"type": "Point", "coordinates": [16.4, 48.2]}, "$maxDistance": 3000000}}}, {"c_custkey": 1}, key="c_custkey")
)
query("geo_near_sorted", f"SELECT c_custkey, round({_D}, 1) AS distance FROM (SELECT *, {_H} AS h FROM {_P}) ORDER BY {_D}, c_custkey LIMIT 20")(lambda s, d: rounded(geo.near_sorted(_places(s, d), "loc", 16.4, 48.2, 20, key="c_custkey").select("c_custkey", "distance"), "distance", to=1))
query("geo_within_bbox", f"SELECT c_custkey FROM {_P} WHERE lon BETWEEN -10 AND 30 AND lat BETWEEN 35 AND 60")(
    lambda s, d: find.find(_places(s, d), {"loc": {"$geoWithin": {"$geometry": {"type": "Polygon", "coordinates": [[[-10, 35], [30, 40], [20, 60], [-10, 35]]]}}}}, {"c_custkey": 1}, key="c_custkey")
)

# --- maintenance -----------------------------------------------------------------------------------------------------

query("ttl_expire", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 36000 SECOND")(
    lambda s, d: maintenance.expire(read(s, d, "events"), "ts", 36000, read(s, d, "events").agg(F.max("ts")).first()[0]).select("event_id")
)
query("capped_docs", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 500")(lambda s, d: maintenance.capped(read(s, d, "events").select("event_id", "value"), max_docs=500, key="event_id").select("event_id"))
query("capped_trim", "SELECT event_id FROM (SELECT event_id, sum(20 + length(CAST(event_id AS VARCHAR)) + length(event_type)) OVER (ORDER BY event_id DESC) AS run FROM (SELECT event_id, event_type FROM events)) WHERE run <= 20000")(
    lambda s, d: maintenance.capped(read(s, d, "events").select(F.col("event_id"), F.col("event_type").alias("k")), max_size=20000, key="event_id").select("event_id")
)
query(
    "validator_errors",
    "SELECT violation, count(*) AS n FROM (SELECT CASE WHEN p_size > 45 THEN 'maximum: p_size' WHEN p_retailprice < 950 THEN 'minimum: p_retailprice' WHEN NOT regexp_matches(p_type, '^[A-Z ]+$') THEN 'pattern: p_type' WHEN p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#21') THEN 'enum: p_brand' END AS violation FROM part) WHERE violation IS NOT NULL GROUP BY 1",
)(
    lambda s, d: validate.violations(
        read(s, d, "part"),
        {"required": ["p_name"], "properties": {"p_size": {"bsonType": "int", "maximum": 45}, "p_retailprice": {"minimum": 950}, "p_type": {"pattern": "^[A-Z ]+$"}, "p_brand": {"enum": ["Brand#11", "Brand#12", "Brand#21"]}}},
    ).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))
)
query("index_unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")(lambda s, d: maintenance.unique_violations(read(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]))
query("index_partial", "SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 300000")(lambda s, d: maintenance.layout(find.find(read(s, d, "orders"), {"o_totalprice": {"$gt": 300000}}, {"o_custkey": 1, "o_orderkey": 1}, key="o_orderkey"), ["o_custkey"]))
query("index_multikey", "SELECT l_linenumber AS value, l_orderkey AS _id FROM lineitem")(lambda s, d: maintenance.multikey(_order_lines(s, d), "numbers"))
query("index_wildcard", "SELECT path, value, n_nationkey FROM (SELECT 'n_name' AS path, n_name AS value, n_nationkey FROM nation UNION ALL SELECT 'n_regionkey', CAST(n_regionkey AS VARCHAR), n_nationkey FROM nation)")(lambda s, d: maintenance.wildcard(read(s, d, "nation"), "n_nationkey"))
query("index_stats", "SELECT count(*) AS entries, count(DISTINCT o_custkey) AS distinct_keys, round(count(DISTINCT o_custkey) / count(*), 6) AS selectivity FROM orders")(lambda s, d: rounded(maintenance.index_stats(read(s, d, "orders"), ["o_custkey"]), "selectivity", to=6))
query("coll_stats", "SELECT count(*) AS count, CAST(sum(length(CAST(n_nationkey AS VARCHAR)) + length(n_name) + length(CAST(n_regionkey AS VARCHAR)) + 43) AS BIGINT) AS size, CAST(sum(length(CAST(n_nationkey AS VARCHAR)) + length(n_name) + length(CAST(n_regionkey AS VARCHAR)) + 43) // count(*) AS BIGINT) AS avg_obj_size FROM nation")(lambda s, d: maintenance.stats(read(s, d, "nation")))

query("index_hash", "SELECT count(DISTINCT o_custkey) AS buckets, count(*) AS n FROM orders")(lambda s, d: read(s, d, "orders").select(maintenance.hash_key(F.col("o_custkey")).alias("h")).agg(F.count_distinct("h").alias("buckets"), F.count(F.lit(1)).alias("n")))
query("split_points", "SELECT array_to_string([quantile_disc(n_nationkey, 0.2), quantile_disc(n_nationkey, 0.4), quantile_disc(n_nationkey, 0.6), quantile_disc(n_nationkey, 0.8)], ',') AS points FROM nation")(
    lambda s, d: maintenance.split_points(read(s, d, "nation"), "n_nationkey", 5).select(F.array_join(F.col("points").cast("array<string>"), ",").alias("points"))
)
query("db_stats", "SELECT 3 AS collections, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + (SELECT count(*) FROM supplier) AS objects")(lambda s, d: _db_stats(s, d))
query("explain_find", "SELECT 'COLLSCAN' AS stage, count(*) AS examined, count(*) FILTER (WHERE n_regionkey = 1) AS returned, '{\"n_regionkey\": {\"$eq\": 1}}' AS parsed FROM nation")(lambda s, d: _explained(s, d))
query("cursor_batches", "SELECT n_nationkey // 7 AS batch, n_nationkey, n_name FROM nation")(lambda s, d: _batches(s, d))
query("find_empty", "SELECT n_nationkey FROM nation WHERE false")(lambda s, d: find.find(read(s, d, "nation").select("n_nationkey"), {"n_nationkey": {"$in": []}}, key="n_nationkey"))
query("index_range_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey >= 100 AND o_custkey < 120")(
    lambda s, d: find.find(maintenance.layout(read(s, d, "orders"), ["o_custkey"]), {"o_custkey": {"$gte": 100, "$lt": 120}}, {"o_orderkey": 1, "o_totalprice": 1}, key="o_orderkey")
)


def _store(s: SparkSession, d: str, *tables: str) -> Engine:
    """A new store below the scratch folder with a database that holds these tables."""
    store = Engine(s, folder(s))
    for t in tables:
        rows = read(s, d, t)
        c = store.database("shop").collection(t)
        c.create(key=rows.columns[0])
        c.insert(rows)
    return store


def _db_stats(s: SparkSession, d: str) -> DataFrame:
    got = _store(s, d, "nation", "region", "supplier").database("shop").stats()
    return s.createDataFrame([(got["collections"], got["objects"])], "collections int, objects long")


def _explained(s: SparkSession, d: str) -> DataFrame:
    told = _store(s, d, "nation").database("shop").collection("nation").explain({"n_regionkey": 1})
    plan, stats = told["queryPlanner"], told["executionStats"]
    return s.createDataFrame([(plan["winningPlan"]["stage"], stats["totalDocsExamined"], stats["nReturned"], json.dumps(plan["parsedQuery"]))], "stage string, examined long, returned long, parsed string")


def _batches(s: SparkSession, d: str) -> DataFrame:
    """A small table through a driver's cursor."""
    c = _store(s, d, "nation").database("shop").collection("nation")
    rows = [(k, r["n_nationkey"], r["n_name"]) for k, part in enumerate(c.cursor(7, sort={"n_nationkey": 1})) for r in part]
    return s.createDataFrame(rows, "batch int, n_nationkey int, n_name string")


# --- oplog and change streams ----------------------------------------------------------------------------------------


def _log(s: SparkSession, d: str) -> DataFrame:
    """Events as an oplog: each user's entries are changes of one document."""
    e = read(s, d, "events")
    op = F.when(F.col("event_type") == "signup", "i").when(F.col("event_type") == "error", "d").otherwise("u")
    return e.select(
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("c"), op.alias("op"), F.lit("shop.users").alias("ns"), F.col("user_id").cast("string").alias("id"),
        F.to_json(F.struct(F.col("user_id").alias("_id"), F.col("value"), F.col("event_type").alias("kind"))).alias("o"), F.to_json(F.struct(F.col("user_id").alias("_id"))).alias("o2"), F.lit(0).cast("long").alias("wall"),
    )


_L = "(SELECT CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_id, user_id, event_type, value FROM events)"
query("oplog_apply", f"SELECT user_id AS _id, value, event_type AS kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec DESC, event_id DESC) AS r FROM {_L}) WHERE r = 1 AND event_type <> 'error'")(
    lambda s, d: oplog.apply(s.createDataFrame([], "_id long, value double, kind string"), _log(s, d), "shop.users")
)
query("oplog_since", f"SELECT count(*) AS n FROM {_L} WHERE sec >= (SELECT (min(sec) + max(sec)) // 2 FROM {_L})")(
    lambda s, d: oplog.since(_log(s, d), _log(s, d).agg(F.expr("(min(ts) + max(ts)) div 2")).first()[0]).agg(F.count(F.lit(1)).alias("n"))
)
query("change_stream_batch", "SELECT 'update' AS op, count(*) AS n FROM events WHERE event_type NOT IN ('signup', 'error') UNION ALL SELECT 'insert', count(*) FROM events WHERE event_type = 'signup'")(
    lambda s, d: changes.events(_log(s, d), ns="shop.users", match={"operationType": {"$in": ["insert", "update"]}}).groupBy(F.col("operationType").alias("op")).agg(F.count(F.lit(1)).alias("n"))
)
query("change_stream_resume", f"SELECT event_id FROM {_L} WHERE (sec, event_id) > (SELECT (sec, event_id) FROM {_L} WHERE event_id = 500)")(lambda s, d: _resumed(s, d))


def _resumed(s: SparkSession, d: str) -> DataFrame:
    log = _log(s, d)
    at = log.filter("c = 500").first()
    out = changes.events(log, ns="shop.users", resumeAfter=changes.token(at["ts"], at["c"]))
    return out.select(F.split(F.unbase64("_id").cast("string"), ":")[1].cast("long").alias("event_id"))


def _written(s: SparkSession, d: str) -> Engine:
    """Writes to one collection within about a second: inserts, updates, deletes, and an insert of what was deleted."""
    store = _store(s, d, "nation")
    c = store.database("shop").collection("nation")
    c.update_many({"n_regionkey": 1}, {"$set": {"n_name": "one"}})
    c.delete({"n_regionkey": {"$in": [2, 3]}})
    c.insert(read(s, d, "nation").filter("n_regionkey = 2").withColumn("n_name", F.lit("back")))
    c.update_many({"n_regionkey": 2}, {"$inc": {"n_regionkey": 10}})
    return store


_WRITTEN = "SELECT n_nationkey, CASE n_regionkey WHEN 1 THEN 'one' WHEN 2 THEN 'back' ELSE n_name END AS n_name, CASE n_regionkey WHEN 2 THEN 12 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_regionkey <> 3"
query("oplog_same_second", _WRITTEN)(lambda s, d: oplog.apply(read(s, d, "nation").limit(0), _written(s, d).database("shop").oplog(), "shop.nation", "n_nationkey"))
query("collection_writes", _WRITTEN)(lambda s, d: _written(s, d).database("shop").collection("nation").rows())
query("oplog_entries", "SELECT 'i' AS op, count(*) + count(*) FILTER (WHERE n_regionkey = 2) AS n FROM nation UNION ALL SELECT 'u', count(*) FILTER (WHERE n_regionkey IN (1, 2)) FROM nation UNION ALL SELECT 'd', count(*) FILTER (WHERE n_regionkey IN (2, 3)) FROM nation")(
    lambda s, d: _written(s, d).database("shop").oplog().groupBy("op").agg(F.count_distinct("ts", "c").alias("n"))
)
query("watch_events", "SELECT 'insert' AS op, count(*) + count(*) FILTER (WHERE n_regionkey = 2) AS n FROM nation UNION ALL SELECT 'update', count(*) FILTER (WHERE n_regionkey IN (1, 2)) FROM nation UNION ALL SELECT 'delete', count(*) FILTER (WHERE n_regionkey IN (2, 3)) FROM nation")(lambda s, d: _watched(s, d))
query("oplog_truncate", f"SELECT count(*) AS n FROM {_L} WHERE sec >= (SELECT (min(sec) + max(sec)) // 2 FROM {_L})")(lambda s, d: _truncated(s, d))
query("change_stream_stage", "SELECT n_nationkey AS id, 'update' AS op FROM nation WHERE n_regionkey IN (1, 2)")(
    lambda s, d: _written(s, d).database("shop").collection("nation").aggregate([{"$changeStream": {}}, {"$match": {"operationType": "update"}}]).select(F.get_json_object("documentKey", "$.n_nationkey").cast("int").alias("id"), F.col("operationType").alias("op"))
)
query("transaction_steps", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'three' ELSE n_name END AS n_name FROM nation WHERE n_regionkey <> 4 UNION ALL SELECT 99, 'new'")(lambda s, d: _transacted(s, d))


def _watched(s: SparkSession, d: str) -> DataFrame:
    got = [e["operationType"] for e in _written(s, d).database("shop").watch(batch=20)]
    return s.createDataFrame([(op, got.count(op)) for op in sorted(set(got))], "op string, n long")


def _truncated(s: SparkSession, d: str) -> DataFrame:
    db = Engine(s, folder(s)).database("shop")
    _log(s, d).write.parquet(f"{db.path}/_oplog")
    db.truncate_oplog(_log(s, d).agg(F.expr("(min(ts) + max(ts)) div 2")).first()[0])
    return db.oplog().agg(F.count(F.lit(1)).alias("n"))


def _transacted(s: SparkSession, d: str) -> DataFrame:
    c = _store(s, d, "nation").database("shop").collection("nation")

    def steps(t) -> None:
        t.insert(s.createDataFrame([(99, "new", 0)], "n_nationkey int, n_name string, n_regionkey int"))
        t.update({"n_nationkey": 3}, {"$set": {"n_name": "three"}})
        t.delete({"n_regionkey": 4, "n_nationkey": {"$ne": 3}})

    c.with_transaction(steps)
    return c.find({}, {"n_nationkey": 1, "n_name": 1})


def _deltas(s: SparkSession, d: str) -> DataFrame:
    """Events as an oplog of deltas: purchases set the value, clicks and (as a bare field) views the kind, errors remove it."""
    e, op = read(s, d, "events"), F.col("event_type")
    o = (
        F.when(op == "purchase", F.to_json(F.struct(F.struct("value").alias("$set"))))
        .when(op == "click", F.to_json(F.struct(F.struct(op.alias("kind")).alias("$set"))))
        .when(op == "view", F.to_json(F.struct(op.alias("kind"))))
        .when(op == "error", F.lit('{"$unset":{"kind":""}}'))
        .otherwise(F.to_json(F.struct(F.col("user_id").alias("_id"), "value", op.alias("kind"))))
    )
    return _log(s, d).join(e.select(F.col("event_id").alias("c"), o.alias("delta")), "c").withColumn("op", F.when(F.get_json_object("o", "$.kind") == "signup", "i").otherwise("u")).withColumn("o", F.col("delta")).select(*oplog.SCHEMA.names)


def _users(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").select(F.col("user_id").alias("_id"), F.lit(-1.0).alias("value"), F.lit("none").alias("kind")).distinct()


query(
    "fold_deltas",
    f"""SELECT u._id, coalesce(v.value, -1.0) AS value, CASE WHEN k.kind IS NULL THEN 'none' WHEN k.kind = 'error' THEN NULL ELSE k.kind END AS kind FROM (SELECT DISTINCT user_id AS _id FROM events) u
    LEFT JOIN (SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec DESC, event_id DESC) AS r FROM {_L} WHERE event_type IN ('purchase', 'signup')) WHERE r = 1) v ON v.user_id = u._id
    LEFT JOIN (SELECT user_id, event_type AS kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec DESC, event_id DESC) AS r FROM {_L} WHERE event_type IN ('click', 'view', 'error', 'signup')) WHERE r = 1) k ON k.user_id = u._id""",
)(lambda s, d: oplog.fold_deltas(_users(s, d), _deltas(s, d), "shop.users"))
query("update_description", "SELECT event_type AS kind, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS updated, count(*) FILTER (WHERE event_type = 'error') AS removed FROM events WHERE event_type <> 'signup' GROUP BY 1")(
    lambda s, d: changes.events(_deltas(s, d), ns="shop.users", deltas=True, match={"operationType": "update"}).join(read(s, d, "events").select(F.col("event_id").cast("string").alias("e"), "event_type"), F.split(F.unbase64("_id").cast("string"), ":")[1] == F.col("e"))
    .groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("updateDescription.updatedFields") != "{}").alias("updated"), F.count_if(F.size("updateDescription.removedFields") == 1).alias("removed"))
)
query("full_document_lookup", "SELECT event_id, CASE WHEN event_type = 'signup' THEN value ELSE -1.0 END AS value FROM events WHERE event_type <> 'error'")(
    lambda s, d: changes.events(_log(s, d), ns="shop.users", mode="updateLookup", full_document=_users(s, d), match={"operationType": {"$ne": "delete"}}).select(F.split(F.unbase64("_id").cast("string"), ":")[1].cast("long").alias("event_id"), F.get_json_object("fullDocument", "$.value").cast("double").alias("value"))
)
query("windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")(lambda s, d: changes.windowed_counts(read(s, d, "events"), "ts", "event_type", "1 hour").select("start", "event_type", "n"))

# --- sources ---------------------------------------------------------------------------------------------------------

# Chunks are cut at bytes, so they are compared as hex; every page is cut.
query("gridfs_chunks", "SELECT page_id AS files_id, CAST(n AS INTEGER) AS n, substring(h, CAST(n AS BIGINT) * 2048 + 1, 2048) AS data FROM (SELECT page_id, h, unnest(range(0, CAST(ceil(length(h) / 2048.0) AS BIGINT))) AS n FROM (SELECT page_id, hex(encode(html)) AS h FROM pages))")(
    lambda s, d: gridfs.split(read(s, d, "pages"), "page_id", "html", 1024)[1].withColumn("data", F.hex("data"))
)
query("gridfs_files", "SELECT page_id AS filename, CAST(strlen(html) AS BIGINT) AS length, md5(html) AS md5 FROM pages")(lambda s, d: gridfs.split(read(s, d, "pages"), "page_id", "html")[0].select("filename", "length", "md5"))
query("gridfs_round_trip", "SELECT page_id AS filename, true AS complete FROM pages")(lambda s, d: gridfs.join(*gridfs.split(read(s, d, "pages"), "page_id", "html", 777)).select("filename", "complete"))
query("gridfs_range", "SELECT substring(hex(encode(html)), 2001, 1000) AS data FROM pages WHERE page_id = (SELECT min(page_id) FROM pages WHERE strlen(html) > 1500)")(lambda s, d: _range(s, d))
query("gridfs_bucket", "SELECT CAST(page_id AS VARCHAR) AS filename, CAST(strlen(html) AS BIGINT) AS length, md5(html) AS md5 FROM pages WHERE page_id <> (SELECT min(page_id) FROM pages)")(lambda s, d: _bucket(s, d))


def _range(s: SparkSession, d: str) -> DataFrame:
    pages = read(s, d, "pages")
    first = pages.filter("octet_length(html) > 1500").agg(F.min("page_id")).first()[0]
    return gridfs.read_range(gridfs.split(pages, "page_id", "html", 512)[1], first, 1000, 500, 512).select(F.hex("data").alias("data"))


def _bucket(s: SparkSession, d: str) -> DataFrame:
    """Pages as files of a bucket, of which the first is deleted, with the checksums of what is in the chunks."""
    pages, bucket = read(s, d, "pages"), gridfs.Bucket(Engine(s, folder(s)).database("shop"), chunk_size=777)
    bucket.add(pages, "page_id", "html")
    bucket.delete(str(pages.agg(F.min("page_id")).first()[0]))
    whole = gridfs.join(bucket.find(), bucket.chunks.rows())
    return whole.select("filename", F.octet_length("content").cast("long").alias("length"), F.md5("content").alias("md5"))


def _saved(s: SparkSession, df: DataFrame, form: str, gzip: bool = False, **options) -> DataFrame:
    path = folder(s)
    backup.write(df, path, form, gzip)
    return backup.read(s, path, df.schema, form, **options)


_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
query("bson_round_trip", _CUSTOMER)(lambda s, d: _saved(s, read(s, d, "customer"), "bson"))
query("backup_bson_gzip", "SELECT event_id, date_trunc('milliseconds', ts) AS ts, user_id, event_type, value, props FROM events")(lambda s, d: _saved(s, read(s, d, "events"), "bson", True))
query("backup_json", "SELECT l_orderkey AS _id, array_to_string(list(l_linenumber ORDER BY l_linenumber), ',') AS numbers FROM lineitem GROUP BY 1")(
    lambda s, d: _saved(s, _order_lines(s, d), "json").select("_id", F.array_join(F.col("numbers").cast("array<string>"), ",").alias("numbers"))
)
query("backup_restore", f"SELECT user_id AS _id, value, event_type AS kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec DESC, event_id DESC) AS r FROM {_L}) WHERE r = 1 AND event_type <> 'error'")(lambda s, d: _restored(s, d))
query("backup_report", "SELECT count(*) AS count, count(*) FILTER (WHERE o_orderkey IS NULL) AS without_key, CAST(0 AS BIGINT) AS repeated_keys FROM orders")(lambda s, d: backup.report(read(s, d, "orders"), "o_orderkey").select("count", "without_key", "repeated_keys"))
query("shell_find", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100.5")(lambda s, d: _shell(s, d))


def _restored(s: SparkSession, d: str) -> DataFrame:
    """A full backup of the first half of the log's state, and the second half as two increments, one of them given twice."""
    log = _log(s, d)
    lo, hi = log.agg(F.min("ts"), F.max("ts")).first()
    a, b = (2 * lo + hi) // 3, (lo + 2 * hi) // 3
    kind = "_id long, value double, kind string"
    full = _saved(s, oplog.apply(s.createDataFrame([], kind), log.filter(F.col("ts") <= a), "shop.users"), "bson")
    second, third = _saved(s, backup.increment(log.filter(F.col("ts") <= b), a), "json"), _saved(s, backup.increment(log, b), "bson")
    return backup.restore(full, [second, third, second], "shop.users")


def _shell(s: SparkSession, d: str) -> DataFrame:
    from vellum.sources.shell import Shell

    shell = Shell(_store(s, d, "customer"), "shop")
    return shell.run("db.customer.find({c_mktsegment: 'BUILDING', c_acctbal: {$gt: 100.5}}, {c_custkey: 1, c_acctbal: 1})")


query("variant_compare", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 90")(lambda s, d: variant.parse(read(s, d, "events"), "props").filter(variant.compare(F.col("doc"), "k", "$gt", 90)).select("event_id"))
query("variant_group", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")(
    lambda s, d: variant.parse(read(s, d, "events"), "props").groupBy(variant.sort_key(variant.get(F.col("doc"), "k")).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.col("key.num").cast("long").alias("k"), "n")
)
