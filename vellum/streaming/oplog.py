"""The oplog: every insert, update and delete as a row of an append-only table.

Columns: ts (seconds), c (counter within a second), op (i, u, d, n), ns (database.collection), id, o (the document after the
change as JSON; of a delete the key), o2 (JSON of the key), wall (milliseconds).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.paths import quoted

SCHEMA = T.StructType([T.StructField(n, T.LongType() if n in ("ts", "c", "wall") else T.StringType()) for n in ("ts", "c", "op", "ns", "id", "o", "o2", "wall")])


def entries(rows: DataFrame, op: str, ns: str, at: dt.datetime, key: str = "_id", start: int = 0) -> DataFrame:
    """Oplog rows of changed rows; counters go by the key's order."""
    if op not in ("i", "u", "d"):
        raise ValueError(f"the operation is i, u or d, not {op!r}")
    key_col = F.col(quoted(key))
    doc = F.struct(*(F.col(quoted(c)) for c in rows.columns)) if op != "d" else F.struct(key_col.alias(key))
    ranges = rows.repartitionByRange(key_col).withColumn("__part", F.spark_partition_id())
    sizes = ranges.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    number = F.row_number().over(Window.partitionBy("__part").orderBy(key_col))
    millis = int(at.replace(tzinfo=at.tzinfo or dt.timezone.utc).timestamp() * 1000)
    numbered = ranges.withColumn("__k", number).join(F.broadcast(before), "__part")  # a row for each partition
    return numbered.select(
        F.lit(millis // 1000).cast("long").alias("ts"),
        (F.col("__k") + F.col("__before") + start).cast("long").alias("c"),
        F.lit(op).alias("op"),
        F.lit(ns).alias("ns"),
        key_col.cast("string").alias("id"),
        F.to_json(doc).alias("o"),
        F.to_json(F.struct(key_col.alias(key))).alias("o2"),
        F.lit(millis).cast("long").alias("wall"),
    )


def since(log: DataFrame, ts: int, c: int | None = None) -> DataFrame:
    """Entries from a second on, or after a place within it."""
    return log.filter(F.col("ts") >= ts) if c is None else log.filter((F.col("ts") > ts) | ((F.col("ts") == ts) & (F.col("c") > c)))


def before(log: DataFrame, ts: int) -> DataFrame:
    """What is left when entries before a second are dropped."""
    return log.filter(F.col("ts") >= ts)


def place() -> Column:
    return F.struct("ts", "c")


def latest(log: DataFrame, ns: str | None = None) -> DataFrame:
    """(ns, id, o): the state that entries of whole documents lead to: the newest of each id, without those deleted."""
    rows = log.filter(F.col("op").isin("i", "u", "d"))
    if ns is not None:
        rows = rows.filter(F.col("ns") == ns)
    newest = rows.groupBy("ns", "id").agg(F.max_by(F.struct("op", "o"), place()).alias("s"))
    return newest.filter("s.op <> 'd'").select("ns", "id", F.col("s.o").alias("o"))


def state(log: DataFrame, schema: T.StructType, ns: str) -> DataFrame:
    """A collection's rows from its entries."""
    return latest(log, ns).select(F.from_json("o", schema).alias("d")).select("d.*")


def apply(base: DataFrame, log: DataFrame, ns: str, key: str = "_id") -> DataFrame:
    """A collection after entries have been replayed on it: inserts, updates and deletes, the newest of each id."""
    rows = log.filter((F.col("ns") == ns) & F.col("op").isin("i", "u", "d"))
    newest = rows.groupBy("id").agg(F.max_by(F.struct("op", "o"), place()).alias("s"))
    kept = base.join(newest.select(F.col("id").alias("__id")), F.col(quoted(key)).cast("string") == F.col("__id"), "left_anti")
    made = newest.filter("s.op <> 'd'").select(F.from_json("s.o", base.schema).alias("d")).select("d.*")
    return kept.unionByName(made)


def fold_deltas(base: DataFrame, log: DataFrame, ns: str, key: str = "_id") -> DataFrame:
    """A collection after entries whose updates are deltas ({$set, $unset} or bare fields, of the top level), in order.

    For each id and field the newest entry that says something of it counts: a whole document says all, a delta its
    fields; entries before an id's last whole document or delete count for nothing. An update of a missing id is an error in
    a document store; here it has no effect.
    """
    kinds = {f.name: f.dataType for f in base.schema.fields}
    rows = log.filter((F.col("ns") == ns) & F.col("op").isin("i", "u", "d")).select("id", "op", "o", place().alias("p"))
    seed = base.select(F.col(quoted(key)).cast("string").alias("id"), F.lit("i").alias("op"), F.to_json(F.struct(*(F.col(quoted(c)) for c in base.columns))).alias("o"), F.struct(F.lit(-1).cast("long").alias("ts"), F.lit(-1).cast("long").alias("c")).alias("p"))
    log_ = seed.unionByName(rows)
    whole = Window.partitionBy("id")
    reset = F.max(F.when(F.col("op") != "u", F.col("p"))).over(whole)
    live = log_.withColumn("reset", reset).filter(F.col("reset").isNotNull() & (F.col("p") >= F.col("reset")))
    fields = "map<string,string>"
    parts = live.select("id", "op", "p", "o", F.from_json(F.get_json_object("o", "$['$set']"), fields).alias("s"), F.from_json(F.get_json_object("o", "$['$unset']"), fields).alias("u"), F.from_json("o", fields).alias("all"))
    aggs = [F.max_by("op", "p").alias("__op"), F.min_by("op", "p").alias("__first")]
    names = [n for n in kinds if n != key]
    for n in names:
        value = F.when(F.col("op") == "i", F.col("all")[n]).otherwise(F.coalesce(F.col("s")[n], F.col("all")[n]))
        says = F.when(F.col("op") == "i", F.lit(True)).otherwise(F.coalesce(F.map_contains_key("s", n), F.lit(False)) | F.coalesce(F.map_contains_key("u", n), F.lit(False)) | F.coalesce(F.map_contains_key("all", n), F.lit(False)))
        gone = (F.col("op") == "u") & F.coalesce(F.map_contains_key("u", n), F.lit(False))
        aggs.append(F.max_by(F.struct(F.when(~gone, value).alias("v")), F.when(says, F.col("p"))).alias(n))
    out = parts.groupBy("id").agg(*aggs).filter("__first = 'i'")

    def typed(n: str) -> Column:
        k, v = kinds[n], F.col(quoted(n))["v"]
        return (F.from_json(v, k) if isinstance(k, (T.StructType, T.ArrayType, T.MapType)) else v.try_cast(k)).alias(n)

    cols = [F.col("id").cast(kinds[key]).alias(key) if n == key else typed(n) for n in kinds]
    return out.select(*cols)


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The oplog folder as a stream of entries."""
    return spark.readStream.schema(SCHEMA).parquet(path)
