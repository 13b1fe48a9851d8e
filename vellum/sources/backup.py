"""Backups: collections as BSON or JSON, oplog increments, restoring with replay, and checking of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators.maintenance import row_size, stats
from vellum.sources import bson
from vellum.streaming import oplog

FORMATS = ("bson", "json", "parquet")


def write(df: DataFrame, path: str, form: str = "bson", gzip: bool = False) -> DataFrame:
    """Writes a collection; returns one row: documents and an order-independent checksum."""
    if form == "bson":
        bson.register(df.sparkSession)
        w = df.write.format("vellum-bson").mode("overwrite")
        (w.option("compression", "gzip") if gzip else w).save(path)
    elif form == "json":
        df.write.mode("overwrite").option("compression", "gzip" if gzip else "none").json(path)
    elif form == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"the format is one of {FORMATS}, not {form!r}")
    return checksum(df)


def read(spark: SparkSession, path: str, schema: T.StructType, form: str = "bson", array: bool = False, lenient: bool = False) -> DataFrame:
    """Reads a backup; ``array``: JSON files that hold an array each; ``lenient``: damaged documents, and only these, are left out."""
    if form == "bson":
        bson.register(spark)
        return spark.read.format("vellum-bson").schema(schema).option("mode", "PERMISSIVE" if lenient else "FAILFAST").load(path)
    if form == "json":
        return spark.read.schema(schema).option("multiLine", array).option("mode", "DROPMALFORMED" if lenient else "FAILFAST").json(path)
    if form == "parquet":
        return spark.read.schema(schema).parquet(path)
    raise ValueError(f"the format is one of {FORMATS}, not {form!r}")


def checksum(df: DataFrame) -> DataFrame:
    """One row: number of documents, and the sum of their hashes, whatever their order."""
    h = F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("checksum"))


def increment(log: DataFrame, since: int) -> DataFrame:
    """The oplog entries of an incremental backup: those after a second."""
    return log.filter(F.col("ts") > since)


def restore(base: DataFrame, increments: list[DataFrame], ns: str, key: str = "_id") -> DataFrame:
    """A full backup with increments replayed on it: inserts, updates and deletes, the newest of each key."""
    if not increments:
        return base
    log = increments[0]
    for more in increments[1:]:
        log = log.unionByName(more)
    return oplog.apply(base, log.dropDuplicates(["ts", "c", "ns", "id", "op"]), ns, key)


def verify(df: DataFrame, documents: int, expected: str) -> bool:
    row = checksum(df).first()
    return (row["documents"], row["checksum"]) == (documents, expected)


def report(df: DataFrame, key: str = "_id") -> DataFrame:
    """One row: documents, bytes, largest document, rows without a key, keys that occur more than once."""
    keys = df.groupBy(F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    twice = keys.filter(F.col(key).isNotNull() & (F.col("n") > 1)).agg(F.count(F.lit(1)).alias("repeated_keys"))
    missing = df.agg(F.coalesce(F.max(row_size(df)), F.lit(0)).alias("largest"), F.count_if(F.col(key).isNull()).alias("without_key"))
    return stats(df).crossJoin(missing).crossJoin(twice)  # one row each


def compact(df: DataFrame, partitions: int) -> DataFrame:
    """The rows in fewer files, without a shuffle."""
    return df.coalesce(partitions)
