"""Files in chunks: a table of files and one of their chunks, made from any binary source."""

from __future__ import annotations

import datetime as dt
import hashlib
import io
import tempfile
import uuid
from collections.abc import Iterator
from typing import TYPE_CHECKING, Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.errors import SpecError
from vellum.functions.paths import quoted

if TYPE_CHECKING:
    from vellum.engine import Collection, Database

CHUNK = 255 * 1024
_BATCH = 32 << 20


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content, uploadDate) of the files below a path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("filename"), "content", F.col("modificationTime").alias("uploadDate"))


def split(df: DataFrame, key: str, content: str, chunk_size: int = CHUNK, **metadata: Column) -> tuple[DataFrame, DataFrame]:
    """(files, chunks) of a table with a binary (or text) column.

    files: filename, length, chunkSize, md5 and the metadata; chunks: files_id, n, data. Empty content has no chunk.
    """
    rows = df.select(F.col(quoted(key)).alias("files_id"), F.col(quoted(content)).cast("binary").alias("content"), *(c.alias(k) for k, c in metadata.items()))
    files = rows.select(F.col("files_id").alias("filename"), F.octet_length("content").cast("long").alias("length"), F.lit(chunk_size).alias("chunkSize"), F.md5("content").alias("md5"), *metadata)
    kind = rows.schema["files_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks as slices of the batch's own bytes, about ``_BATCH`` bytes of them at once."""
        for b in batches:
            content = b.column(1).cast(pa.large_binary())
            _, offs, data = content.buffers()
            off = np.frombuffer(offs, np.int64)[content.offset : content.offset + len(content) + 1]
            size = np.diff(off)
            count = -(-size // chunk_size)
            row = np.repeat(np.arange(len(size)), count)
            n = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            bounds = np.append(off[row] + n * chunk_size, off[-1])
            step = max(1, _BATCH // chunk_size)
            for a in range(0, len(row), step):
                z = min(a + step, len(row))
                part = pa.LargeBinaryArray.from_buffers(pa.large_binary(), z - a, [None, pa.py_buffer(np.ascontiguousarray(bounds[a : z + 1])), data])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[a:z])), pa.array(n[a:z].astype(np.int32)), part.cast(pa.binary())], names=["files_id", "n", "data"])

    return files, rows.select("files_id", "content").filter("octet_length(content) > 0").mapInArrow(cut, f"files_id {kind}, n int, data binary")


def _whole() -> Column:
    """The chunks of a group put together in order, in time that is linear in the file."""
    return F.coalesce(F.expr("listagg(data) WITHIN GROUP (ORDER BY n)"), F.lit(b""))


def join(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(filename, content, complete): the files put together, and whether length and md5 agree."""
    parts = chunks.groupBy("files_id").agg(_whole().alias("content"))
    out = files.join(parts, files["filename"] == parts["files_id"], "left").withColumn("content", F.coalesce("content", F.lit(b"")))
    return out.select("filename", "content", ((F.octet_length("content") == F.col("length")) & (F.md5("content") == F.col("md5"))).alias("complete"))


def replace(files: DataFrame, new: DataFrame) -> DataFrame:
    """The table of files after an upload: a later file of the same name takes the place of the former."""
    return files.join(new.select("filename").distinct(), "filename", "left_anti").unionByName(new, allowMissingColumns=True)


def newest(files: DataFrame, by: str = "uploadDate") -> DataFrame:
    """Of files of one name the newest."""
    w = Window.partitionBy("filename").orderBy(F.col(by).desc())
    return files.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def read_range(chunks: DataFrame, name: str, start: int, size: int, chunk_size: int = CHUNK) -> DataFrame:
    """One row: the bytes of a range of a file; only the chunks that hold it are read."""
    lo, hi = start // chunk_size, max(start + size - 1, start) // chunk_size
    rows = chunks.filter((F.col("files_id") == name) & F.col("n").between(lo, hi))
    return rows.agg(_whole().alias("w")).select(F.substring("w", F.lit(start - lo * chunk_size + 1), F.lit(size)).alias("data"))


def rename(files: DataFrame, old: str, new: str) -> DataFrame:
    return files.withColumn("filename", F.when(F.col("filename") == old, new).otherwise(F.col("filename")))


def delete(files: DataFrame, chunks: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    return files.filter(F.col("filename") != name), chunks.filter(F.col("files_id") != name)


# --- buckets: files of a database, read and written as streams on the driver, or in bulk as tables ---------------------

FILES = "_id string, filename string, length long, chunkSize int, uploadDate timestamp, md5 string, contentType string, aliases array<string>, metadata map<string,string>"
CHUNKS = "_id string, files_id string, n int, data binary"


class Bucket:
    """Files and chunks as two collections of a database, ``<name>.files`` and ``<name>.chunks``."""

    def __init__(self, database: "Database", name: str = "fs", chunk_size: int = CHUNK):
        if not 1 <= chunk_size <= 16 << 20:
            raise SpecError("a chunk has from 1 byte to 16 MB")
        self.database, self.name, self.chunk_size = database, name, chunk_size

    @property
    def files(self) -> "Collection":
        return self.database.collection(f"{self.name}.files")

    @property
    def chunks(self) -> "Collection":
        return self.database.collection(f"{self.name}.chunks")

    def add(self, df: DataFrame, key: str, content: str) -> None:
        """Adds a row's content as a file each, named (and with the id) by the key; all of it in tasks."""
        files, chunks = split(df, key, content, self.chunk_size)
        name = F.col("filename").cast("string")
        more = {"contentType": "string", "aliases": "array<string>", "metadata": "map<string,string>"}
        rows = files.select(name.alias("_id"), name.alias("filename"), "length", F.lit(self.chunk_size).alias("chunkSize"), F.current_timestamp().alias("uploadDate"), "md5", *(F.lit(None).cast(t).alias(n) for n, t in more.items()))
        ids = F.col("files_id").cast("string")
        # Chunks first: a file is only there when all of it is.
        self.chunks.insert(chunks.select(F.concat_ws("-", ids, F.format_string("%010d", "n")).alias("_id"), ids.alias("files_id"), "n", "data"))
        self.files.insert(rows)

    def open_upload(self, filename: str, id: str | None = None, **about: Any) -> "Upload":
        """A stream to write; contentType, aliases and metadata may be given."""
        return Upload(self, filename, id or uuid.uuid4().hex, about)

    def upload(self, filename: str, source: Any, **about: Any) -> str:
        """Writes bytes, or what a file object holds; returns the new id."""
        with self.open_upload(filename, **about) as out:
            stream = io.BytesIO(source) if isinstance(source, (bytes, bytearray)) else source
            while part := stream.read(1 << 20):
                out.write(part)
        return out.id

    def open_download(self, id: str) -> "Download":
        found = self.find_one({"_id": id})
        if found is None:
            raise FileNotFoundError(id)
        return Download(self, found)

    def open_download_by_name(self, filename: str) -> "Download":
        """The newest file of a name."""
        found = self.find({"filename": filename}, sort={"uploadDate": -1, "_id": 1}, limit=1).first()
        if found is None:
            raise FileNotFoundError(filename)
        return Download(self, found.asDict(recursive=True))

    def download(self, id: str, to: Any) -> int:
        """Copies a file into a file object; returns its length."""
        n, stream = 0, self.open_download(id)
        while part := stream.read(8 * self.chunk_size):
            n += to.write(part)
        return n

    def find(self, filter: dict | None = None, **options: Any) -> DataFrame:
        return self.files.find(filter, **options)

    def find_one(self, filter: dict) -> dict | None:
        return self.files.find_one(filter)

    def rename(self, id: str, filename: str) -> None:
        self.files.update_one({"_id": id}, {"$set": {"filename": filename}})

    def delete(self, id: str) -> None:
        self.files.delete({"_id": id})
        self.chunks.delete({"files_id": id})

    def delete_by_name(self, filename: str) -> None:
        """Deletes all files of a name."""
        for row in self.find({"filename": filename}).select("_id").toLocalIterator():
            self.delete(row["_id"])

    def drop(self) -> None:
        self.files.drop()
        self.chunks.drop()


class Upload(io.RawIOBase):
    """Bytes for a new file, spooled until it is closed; an upload that is aborted, or ends in an error, leaves nothing."""

    def __init__(self, bucket: Bucket, filename: str, id: str, about: dict):
        if about.keys() - {"contentType", "aliases", "metadata"}:
            raise SpecError(f"unknown: {sorted(about)}")
        self.bucket, self.filename, self.id, self.about = bucket, filename, id, about
        self.spool, self.md5, self.length, self.open = tempfile.SpooledTemporaryFile(64 << 20), hashlib.md5(), 0, True

    def writable(self) -> bool:
        return True

    def write(self, part: Any) -> int:
        if not self.open:
            raise ValueError("the upload is over")
        self.spool.write(part)
        self.md5.update(part)
        self.length += len(part)
        return len(part)

    def abort(self) -> None:
        self.open = False
        self.spool.close()

    def __exit__(self, kind: Any, *rest: Any) -> None:
        self.abort() if kind else self.close()

    def close(self) -> None:
        if getattr(self, "open", False):
            self.open, b = False, self.bucket
            spark = b.database.engine.spark
            self.spool.seek(0)
            rows = ((f"{self.id}-{n:010d}", self.id, n, part) for n, part in enumerate(iter(lambda: self.spool.read(b.chunk_size), b"")))
            while part := [r for _, r in zip(range(max(1, (64 << 20) // b.chunk_size)), rows)]:
                b.chunks.insert(spark.createDataFrame(part, CHUNKS))
            about = [self.about.get(k) for k in ("contentType", "aliases", "metadata")]
            b.files.insert(spark.createDataFrame([(self.id, self.filename, self.length, b.chunk_size, dt.datetime.now(dt.timezone.utc), self.md5.hexdigest(), *about)], FILES))
            self.spool.close()
        super().close()


class Download(io.RawIOBase):
    """A file's bytes from any place on; only the chunks that hold what is read are fetched."""

    def __init__(self, bucket: Bucket, file: dict):
        self.bucket, self.file, self.at = bucket, file, 0
        self.held: tuple[int, bytes] = (-1, b"")

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + (0 if whence == io.SEEK_SET else self.at if whence == io.SEEK_CUR else self.file["length"])
        if not 0 <= at <= self.file["length"]:
            raise ValueError("outside of the file")
        self.at = at
        return at

    def read(self, n: int = -1) -> bytes:
        left = self.file["length"] - self.at
        n = left if n is None or n < 0 else min(n, left)
        if not n:
            return b""
        size = self.file["chunkSize"]
        lo, hi = self.at // size, (self.at + n - 1) // size
        if lo == hi == self.held[0]:
            raw = self.held[1]
        else:
            rows = self.bucket.chunks.rows().filter((F.col("files_id") == self.file["_id"]) & F.col("n").between(lo, hi)).select("n", "data").orderBy("n").collect()
            if [r["n"] for r in rows] != list(range(lo, hi + 1)):
                raise ValueError(f"chunks of {self.file['filename']} are missing")
            raw = b"".join(bytes(r["data"]) for r in rows)
            self.held = (hi, bytes(rows[-1]["data"]))
        out = raw[self.at - lo * size : self.at - lo * size + n]
        self.at += len(out)
        return out
