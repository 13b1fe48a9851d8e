"""Helpers shared by the corpus operators: column picking, shared storage, Arrow text access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.shipping import ship

U = np.uint64
MASK = (1 << 64) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def positional(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by position, so that no two names can clash."""
    ship(df.sparkSession)
    return df.toDF(*(f"__c{i}" for i in range(len(df.columns))))


def index_of(df: DataFrame, name: str) -> int:
    """Position of a column: the first exact match, else the first that differs only in case."""
    cols = df.columns
    if name in cols:
        return cols.index(name)
    folded = [c.lower() for c in cols]
    if name.lower() in folded:
        return folded.index(name.lower())
    raise ValueError(f"no column {name!r} among {cols}")


def pick(df: DataFrame, **casts: str) -> DataFrame:
    """Only the named columns, each cast to the given type; other columns, however named, don't matter."""
    plain = positional(df)
    return plain.select(*(F.col(f"__c{index_of(df, n)}").cast(t).alias(n) for n, t in casts.items()))


def doc_rows(df: DataFrame) -> DataFrame:
    ship(df.sparkSession)
    return pick(df, doc_id="long", text="string")


def shared_dir(spark: SparkSession) -> str:
    """The URI of a new folder below the checkpoint folder that all executors share.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset and Spark runs on this machine alone, as in
    tests, a temporary folder is set in its stead; on a cluster that would be another folder on each machine, and an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        if held is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = held.rsplit("/", 1)[0] if held else "file://" + tempfile.mkdtemp(prefix="vellum-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/vellum-{uuid.uuid4().hex}")
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def saved_at(df: DataFrame, spark: SparkSession) -> tuple[DataFrame, str]:
    """(``df`` written as Parquet to the shared folder and read again, that folder's URI)."""
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, spark: SparkSession) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: it cuts lineage and survives lost executors."""
    return saved_at(df, spark)[0]


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return off - off[0], raw


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser of a uint64 array."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BASE = 0x9E3779B97F4A7C55 | 1
_POW: dict[int, np.ndarray] = {}
#: Batches of up to so many bytes are hashed by differences of one running sum; it takes tables of 16 bytes for each.
_TABLE = 1 << 22


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """The first n powers of the hash base (or its inverse) modulo 2**64."""
    held = _POW.get(base)
    if held is None or len(held) < n:
        p = np.full(max(n, 256), base, np.uint64)
        p[0] = 1
        held = _POW[base] = np.multiply.accumulate(p)
    return held[:n]


def inverse_powers(n: int) -> np.ndarray:
    return powers(n, pow(_BASE, -1, 1 << 64))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Per-byte random values, so that the polynomial isn't taken over small integers.
_BYTE = mix(np.arange(256, dtype=np.uint64) * U(0xD1342543DE82EF95))


class Words:
    """White-space separated words of a batch of texts, as numpy arrays over the batch's bytes.

    start, end: byte bounds of each word; doc: its text's index; hash: 64-bit polynomial hash of its bytes;
    first: for each text, the index of its first word (one more entry at the end).
    """

    def __init__(self, off: np.ndarray, raw: np.ndarray):
        self.off, self.raw = off, raw
        n = len(raw)
        space = _SPACE[raw]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        word = ~space
        starts = word & (before | edge[:n])
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(word & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off, side="left")
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        if len(self.start) and n <= _TABLE:
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[raw] * powers(n), out=total[1:])
            part = (total[self.end] - total[self.start]) * inverse_powers(n)[self.start]
            self.hash = mix(part + (self.end - self.start).astype(np.uint64))
        elif len(self.start):
            at = np.flatnonzero(word)
            length = self.end - self.start
            cum = np.concatenate(([0], np.cumsum(length)))
            pos = np.arange(len(at)) - np.repeat(cum[:-1], length)
            terms = _BYTE[raw[at]] * powers(int(length.max()))[pos]
            self.hash = mix(np.add.reduceat(terms, cum[:-1]) + length.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.start)

    def room(self) -> np.ndarray:
        """How many words each word has from itself to the end of its text."""
        return self.first[self.doc + 1] - np.arange(len(self))


def chars_before(raw: np.ndarray) -> np.ndarray:
    """For each byte offset, the number of characters (UTF-8 lead bytes) before it."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def slices(batch: pa.RecordBatch, *texts: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts (columns by index) hold about ``limit`` bytes, at least one row each."""
    if not batch.num_rows:
        return
    size = np.zeros(batch.num_rows, np.int64)
    for i in texts:
        size += np.nan_to_num(pa.compute.binary_length(batch.column(i)).cast(pa.float64()).to_numpy(zero_copy_only=False)).astype(np.int64)
    part = (np.cumsum(size) - size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
