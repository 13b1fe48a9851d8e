"""BSON: a codec, and a Spark data source that reads and writes files of concatenated documents.

Python values: int (32 or 64 bits by size), float, str, dict, list, bytes, bool, datetime (UTC, milliseconds), None, and
``ObjectId``, ``Regex``, ``Timestamp`` and ``Decimal128`` below.
"""

from __future__ import annotations

import datetime as dt
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql import types as T

_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


@dataclass(frozen=True, order=True)
class ObjectId:
    raw: bytes

    def __str__(self) -> str:
        return self.raw.hex()


@dataclass(frozen=True)
class Regex:
    pattern: str
    options: str = ""


@dataclass(frozen=True, order=True)
class Timestamp:
    value: int


@dataclass(frozen=True)
class Decimal128:
    raw: bytes


class MinKey:
    pass


class MaxKey:
    pass


def _name(s: str) -> bytes:
    raw = s.encode()
    if b"\0" in raw:
        raise ValueError("a field name can't hold a zero byte")
    return raw + b"\0"


def _text(s: str) -> bytes:
    raw = s.encode()
    return struct.pack("<i", len(raw) + 1) + raw + b"\0"


def _element(v: Any) -> tuple[int, bytes]:
    if v is None:
        return 0x0A, b""
    if isinstance(v, bool):
        return 0x08, b"\1" if v else b"\0"
    if isinstance(v, int):
        return (0x10, struct.pack("<i", v)) if -(2**31) <= v < 2**31 else (0x12, struct.pack("<q", v))
    if isinstance(v, float):
        return 0x01, struct.pack("<d", v)
    if isinstance(v, str):
        return 0x02, _text(v)
    if isinstance(v, dict):
        return 0x03, encode(v)
    if isinstance(v, (list, tuple)):
        return 0x04, encode({str(i): x for i, x in enumerate(v)})
    if isinstance(v, (bytes, bytearray)):
        return 0x05, struct.pack("<iB", len(v), 0) + bytes(v)
    if isinstance(v, ObjectId):
        return 0x07, v.raw
    if isinstance(v, dt.datetime):
        when = v if v.tzinfo else v.replace(tzinfo=dt.timezone.utc)
        return 0x09, struct.pack("<q", (when - _EPOCH) // dt.timedelta(milliseconds=1))
    if isinstance(v, dt.date):
        return _element(dt.datetime(v.year, v.month, v.day))
    if isinstance(v, Regex):
        return 0x0B, _name(v.pattern) + _name(v.options)
    if isinstance(v, Timestamp):
        return 0x11, struct.pack("<Q", v.value)
    if isinstance(v, Decimal128):
        return 0x13, v.raw
    if isinstance(v, MinKey):
        return 0xFF, b""
    if isinstance(v, MaxKey):
        return 0x7F, b""
    raise TypeError(f"no BSON type for {type(v).__name__}")


def encode(doc: dict) -> bytes:
    body = b"".join(bytes([kind]) + _name(k) + raw for k, v in doc.items() for kind, raw in [_element(v)])
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def _zero(raw: bytes, at: int) -> tuple[str, int]:
    end = raw.index(b"\0", at)
    return raw[at:end].decode(), end + 1


def _value(kind: int, raw: bytes, at: int) -> tuple[Any, int]:
    if kind == 0x01:
        return struct.unpack_from("<d", raw, at)[0], at + 8
    if kind in (0x02, 0x0D, 0x0E):
        (n,) = struct.unpack_from("<i", raw, at)
        return raw[at + 4 : at + 3 + n].decode(), at + 4 + n
    if kind in (0x03, 0x04):
        (n,) = struct.unpack_from("<i", raw, at)
        doc = decode(raw[at : at + n])
        return (doc if kind == 0x03 else list(doc.values())), at + n
    if kind == 0x05:
        (n,) = struct.unpack_from("<i", raw, at)
        return raw[at + 5 : at + 5 + n], at + 5 + n
    if kind == 0x07:
        return ObjectId(raw[at : at + 12]), at + 12
    if kind == 0x08:
        return raw[at] != 0, at + 1
    if kind == 0x09:
        return _EPOCH + dt.timedelta(milliseconds=struct.unpack_from("<q", raw, at)[0]), at + 8
    if kind in (0x06, 0x0A):
        return None, at
    if kind == 0x0B:
        pattern, at = _zero(raw, at)
        options, at = _zero(raw, at)
        return Regex(pattern, options), at
    if kind == 0x10:
        return struct.unpack_from("<i", raw, at)[0], at + 4
    if kind == 0x11:
        return Timestamp(struct.unpack_from("<Q", raw, at)[0]), at + 8
    if kind == 0x12:
        return struct.unpack_from("<q", raw, at)[0], at + 8
    if kind == 0x13:
        return Decimal128(raw[at : at + 16]), at + 16
    if kind == 0xFF:
        return MinKey(), at
    if kind == 0x7F:
        return MaxKey(), at
    raise ValueError(f"unknown BSON type {kind:#x}")


def decode(raw: bytes) -> dict:
    if len(raw) < 5 or struct.unpack_from("<i", raw)[0] != len(raw) or raw[-1] != 0:
        raise ValueError("a damaged document")
    out, at = {}, 4
    while at < len(raw) - 1:
        kind = raw[at]
        name, at = _zero(raw, at + 1)
        out[name], at = _value(kind, raw, at)
    return out


def documents(raw: bytes) -> Iterator[bytes]:
    """The documents of a run of them."""
    at = 0
    while at < len(raw):
        (n,) = struct.unpack_from("<i", raw, at)
        if n < 5 or at + n > len(raw):
            raise ValueError("a damaged document")
        yield raw[at : at + n]
        at += n


def plain(v: Any) -> Any:
    """A value in extended JSON."""
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, ObjectId):
        return {"$oid": str(v)}
    if isinstance(v, dt.datetime):
        when = v if v.tzinfo else v.replace(tzinfo=dt.timezone.utc)
        return {"$date": when.astimezone(dt.timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")}
    if isinstance(v, (bytes, bytearray)):
        import base64

        return {"$binary": {"base64": base64.b64encode(bytes(v)).decode(), "subType": "00"}}
    if isinstance(v, Regex):
        return {"$regularExpression": {"pattern": v.pattern, "options": v.options}}
    if isinstance(v, Timestamp):
        return {"$timestamp": {"t": v.value >> 32, "i": v.value & 0xFFFFFFFF}}
    if isinstance(v, Decimal128):
        return {"$numberDecimalBytes": v.raw.hex()}
    if isinstance(v, (MinKey, MaxKey)):
        return {"$minKey" if isinstance(v, MinKey) else "$maxKey": 1}
    return v


def _fit(v: Any, kind: T.DataType) -> Any:
    """A decoded value for a column of a type; NULL where it doesn't fit."""
    if v is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_fit(v.get(f.name), f.dataType) for f in kind.fields) if isinstance(v, dict) else None
    if isinstance(kind, T.ArrayType):
        return [_fit(x, kind.elementType) for x in v] if isinstance(v, list) else None
    if isinstance(kind, T.StringType):
        return v if isinstance(v, str) else str(v) if isinstance(v, ObjectId) else json.dumps(plain(v))
    if isinstance(kind, T.BooleanType):
        return v if isinstance(v, bool) else None
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        v = v.value if isinstance(v, Timestamp) else v
        return int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and v == int(v) else None
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    if isinstance(kind, T.BinaryType):
        return v.raw if isinstance(v, ObjectId) else v if isinstance(v, bytes) else None
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        if not isinstance(v, dt.datetime):
            return None
        return v.replace(tzinfo=None) if isinstance(kind, T.TimestampNTZType) else v
    return None


#: Bytes of a plain file that one task reads; documents and bytes that a batch of rows is made of; the greatest document.
SPLIT_BYTES, BATCH, BATCH_BYTES, LARGEST = 64 << 20, 8_000, 16 << 20, 48 << 20
#: The level that gzip itself has; 9, Python's, takes five times as long for a twelfth less.
GZIP_LEVEL = 6
_KINDS = frozenset([*range(0x01, 0x14), 0x7F, 0xFF])
_DAMAGE = (ValueError, struct.error, IndexError, OverflowError, RecursionError)


class _Part(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


class _Source:
    """A file's bytes from any place on, with some read ahead; compressed files only go forward."""

    def __init__(self, path: str):
        import gzip

        files, name = _open(path)
        self.plain = not path.endswith(".gz")
        self.file = files.open_input_file(name)
        self.stream = None if self.plain else gzip.GzipFile(fileobj=self.file)
        self.size = self.file.size() if self.plain else None
        self.at, self.held = 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes at a place."""
        if not self.at <= at <= self.at + len(self.held):
            if self.plain or at < self.at:
                self.at, self.held = at, b""
        have = self.at + len(self.held) - at
        if have < n:
            more = max(n - have, 1 << 20)
            rest = self.held[at - self.at :]
            if self.plain:
                self.file.seek(at + len(rest))
            self.held = rest + ((self.file if self.plain else self.stream).read(more) or b"")
            self.at = at
        return self.held[at - self.at : at - self.at + n]

    def document(self, at: int) -> bytes | None:
        """The bytes that the length at a place claims; None at the end; ValueError where it can't be."""
        head = self.get(at, 4)
        if not head:
            return None
        n = struct.unpack("<i", head)[0] if len(head) == 4 else 0
        if not 5 <= n <= LARGEST:
            raise ValueError("a damaged document")
        raw = self.get(at, n)
        if len(raw) < n or raw[-1] != 0:
            raise ValueError("a damaged document")
        return raw

    def held_documents(self, at: int, end: int | None) -> list[bytes]:
        """Documents from a place on that are whole in what was read, as far as they look sound: those that begin before the end."""
        out, held, k = [], self.held, at - self.at
        stop = len(held) if end is None else min(len(held), end - self.at)
        if k < 0:
            return out
        while k < stop - 4:
            n = int.from_bytes(held[k : k + 4], "little", signed=True)
            if not 5 <= n <= LARGEST or k + n > len(held) or held[k + n - 1]:
                break
            out.append(held[k : k + n])
            k += n
        return out

    def next_start(self, at: int, chain: int = 8) -> int | None:
        """The first place from here on where documents begin, judged by a row of them that can be read; None if there's none."""
        while True:
            raw = self.get(at, 1 << 16)
            if len(raw) < 5:
                return None
            for k in range(len(raw) - 4):
                n = int.from_bytes(raw[k : k + 4], "little", signed=True)
                if 5 <= n <= LARGEST and (raw[k + 4] in _KINDS or n == 5) and self._chain(at + k, chain):
                    return at + k
            at += len(raw) - 4

    def _chain(self, at: int, left: int) -> bool:
        try:
            while left and (raw := self.document(at)) is not None:
                decode(raw)
                at, left = at + len(raw), left - 1
        except _DAMAGE:
            return False
        return True


class BsonReader(DataSourceReader):
    """Plain files are cut at about ``splitBytes``: a task begins with the first document from its cut on, and makes sure that its
    last one ends where the next task begins. Compressed files are read by one task each, in a stream. With a mode other than
    FAILFAST a damaged document is left out; where its length is damaged too, reading goes on with the next document found.
    """

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        split, out = int(self.options.get("splitbytes", self.options.get("splitBytes", SPLIT_BYTES))), []
        for p in list_files(self.options["path"], (".bson", ".bson.gz")):
            files, name = _open(p)
            size = files.get_file_info(name).size
            cuts = [0, *range(split, size, split)] if p.endswith(".bson") and split > 0 else [0]
            out += [_Part(p, a, b) for a, b in zip(cuts, [*cuts[1:], None])]
        return out

    def read(self, partition: InputPartition) -> Iterator[Any]:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        lenient = self.options.get("mode", "FAILFAST").upper() != "FAILFAST"
        schema = to_arrow_schema(self.schema)
        raws: list[bytes] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(_arrays(raws, self.schema, schema, lenient), schema=schema)

        for raw in self._documents(partition, lenient):
            raws.append(raw)
            held += len(raw)
            if len(raws) == BATCH or held >= BATCH_BYTES:
                yield batch()
                raws, held = [], 0
        if raws:
            yield batch()

    def _documents(self, part: InputPartition, lenient: bool) -> Iterator[bytes]:
        source = _Source(part.path)
        at = source.next_start(part.start) if part.start else 0
        end = part.end
        while at is not None and (end is None or at < end):
            if some := source.held_documents(at, end):
                yield from some
                at += sum(map(len, some))
                continue
            try:
                raw = source.document(at)
                if raw is None:
                    return
            except _DAMAGE:
                if not lenient:
                    raise
                at = source.next_start(at + 1)
                continue
            at += len(raw)
            yield raw
        if end is not None and not lenient and at != source.next_start(end) and source.document(at) is not None:
            raise ValueError(f"{part.path} can't be cut at {end}: read it with splitBytes=0")


def _arrays(raws: list[bytes], kinds: T.StructType, schema, lenient: bool) -> list:
    """The columns of some documents, in their order; with ``lenient`` without the damaged ones."""
    import numpy as np
    import pyarrow as pa

    good, columns = _fast_arrays(raws, kinds, schema)
    if good is not None and good.all():
        return columns
    rows, order, n = [], [], len(raws) if good is not None else 0
    for i, raw in enumerate(raws):
        if good is not None and good[i]:
            order.append(i)
            continue
        try:
            doc = decode(raw)
        except _DAMAGE:
            if not lenient:
                raise
            continue
        order.append(n + len(rows))
        rows.append(tuple(_fit_arrow(doc.get(f.name), f.dataType) for f in kinds.fields))
    slow = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)]
    if good is None:
        return slow
    return [pa.concat_arrays([c, s]).take(pa.array(np.array(order, "int64"))) for c, s in zip(columns, slow)]


_INTEGERS = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8}
_FAST = (*_INTEGERS, T.FloatType, T.DoubleType, T.BooleanType, T.StringType, T.BinaryType, T.TimestampType, T.TimestampNTZType)
#: Milliseconds that a datetime can hold.
_TIMES = (-62_135_596_800_000, 253_402_300_799_999)


def _fast_arrays(raws: list[bytes], kinds: T.StructType, schema) -> tuple[Any, list]:
    """Which documents have fields of the schema only, in its order and of its columns' own types (any may be missing or null),
    and columns in which these documents' values are right. A column's values are taken from all documents at once. (None, [])
    for schemas with other types than plain ones. The other documents are for ``decode``, which also finds what is damaged.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if len(set(kinds.names)) < len(kinds.names) or any(type(f.dataType) not in _FAST or "\0" in f.name for f in kinds.fields):
        return None, []
    names = [_name(f.name) for f in kinds.fields]
    buffer = b"".join([*raws, bytes(max(map(len, names), default=0) + 16)])  # places behind the last document can be looked at
    data = np.frombuffer(buffer, np.uint8)
    starts = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))
    last, starts = starts - 1, np.concatenate([[0], starts[:-1]])
    at, values = starts + 4, []

    def number(places: Any, kind: str) -> Any:
        size = np.dtype(kind).itemsize
        return np.ascontiguousarray(data[np.minimum(places, len(data) - size)[:, None] + np.arange(size)]).view(kind)[:, 0]

    for f, name in zip(kinds.fields, names):
        tag, kind, size = data[at], type(f.dataType), len(name)
        body = at + 1 + size
        named = (data[at[:, None] + np.arange(1, size + 1)] == np.frombuffer(name, np.uint8)).all(axis=1) & (body <= last)
        if kind in _INTEGERS:
            small, most = tag == 0x10, (1 << (8 * _INTEGERS[kind] - 1)) - 1
            value = np.where(small, number(body, "<i4"), number(body, "<i8"))
            after = body + np.where(small, 4, 8)
            fits = (small | (tag == 0x12)) & (value >= -most - 1) & (value <= most)
        elif kind in (T.FloatType, T.DoubleType):
            value, after, fits = number(body, "<f8"), body + 8, tag == 0x01
        elif kind is T.BooleanType:
            value, after, fits = data[body] != 0, body + 1, tag == 0x08
        elif kind in (T.TimestampType, T.TimestampNTZType):
            value, after = number(body, "<i8"), body + 8
            fits = (tag == 0x09) & (value >= _TIMES[0]) & (value <= _TIMES[1])
        else:
            text, length = kind is T.StringType, number(body, "<i4").astype(np.int64)
            first = body + (4 if text else 5)
            after = first + length
            value = (first, after - 1 if text else after)
            fits = ((tag == 0x02) if text else (tag == 0x05)) & (length >= (1 if text else 0))
        there = named & fits & (after <= last)
        at = np.where(there, after, np.where(named & (tag == 0x0A), body, at))
        values.append((there, value))
    good, columns = at == last, []
    for f, (there, value) in zip(schema, values):
        there = there & good
        if isinstance(value, tuple):
            # The values and what lies between them, by turns; every other one is taken.
            ends = np.stack([np.where(there, v, starts) for v in value], axis=1).astype(np.int32)
            turns = pa.Array.from_buffers(pa.binary(), 2 * len(raws) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(buffer)])
            column = turns.take(pa.array(np.arange(0, 2 * len(raws), 2)))
            try:
                column = column.cast(f.type)
            except pa.ArrowInvalid:  # a text that isn't UTF-8
                return np.zeros(len(raws), bool), [pa.nulls(len(raws), s.type) for s in schema]
            columns.append(column if there.all() else pc.if_else(pa.array(there), column, pa.scalar(None, f.type)))
        else:
            value = np.where(there, value, 0)
            if pa.types.is_timestamp(f.type):
                columns.append(pa.array(value * 1000, pa.int64(), mask=~there).cast(f.type))
            else:
                with np.errstate(over="ignore"):
                    columns.append(pa.array(value.astype(f.type.to_pandas_dtype()), f.type, mask=~there))
    return good, columns


def _fit_arrow(v: Any, kind: T.DataType) -> Any:
    """``_fit`` for Arrow, which takes structs by name."""
    v = _fit(v, kind)

    def named(x: Any, k: T.DataType) -> Any:
        if x is None:
            return None
        if isinstance(k, T.StructType):
            return {f.name: named(y, f.dataType) for f, y in zip(k.fields, x)}
        return [named(y, k.elementType) for y in x] if isinstance(k, T.ArrayType) else x

    return named(v, kind)


@dataclass
class _Done(WriterCommitMessage):
    temporary: str | None
    final: str | None


class BsonWriter(DataSourceWriter):
    """Each task writes a file of its own name; files get their final names when the job is committed."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.gzip, self.overwrite = options["path"], options.get("compression", "") == "gzip", overwrite
        self.job = uuid.uuid4().hex[:12]

    def write(self, iterator) -> WriterCommitMessage:
        import gzip

        from pyspark import TaskContext

        context = TaskContext.get()
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        end = ".bson.gz" if self.gzip else ".bson"
        temporary = f"{root}/.tmp-{context.partitionId()}-{context.taskAttemptId()}"
        some = False
        with files.open_output_stream(temporary, compression=None) as raw:
            out = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0, compresslevel=GZIP_LEVEL) if self.gzip else raw
            for part in self._encoded(iterator):
                some = True
                out.write(part)
            if self.gzip:
                out.close()
        return _Done(temporary, f"{root}/part-{context.partitionId():05d}-{self.job}{end}" if some else None)

    def _encoded(self, iterator) -> Iterator[Any]:
        for row in iterator:
            yield encode({k: v for k, v in _unrow(row).items() if v is not None})

    def commit(self, messages) -> None:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        old = list_files(self.path, (".bson", ".bson.gz")) if self.overwrite else []
        for m in messages:
            if m.final is None:
                files.delete_file(m.temporary)
            else:
                files.move(m.temporary, m.final)
        # The old files go when the new ones are there: a writer that is lost in between leaves too many rows, never too few.
        for p in old:
            files.delete_file(_open(p)[1])

    def abort(self, messages) -> None:
        files, _ = _open(self.path)
        for m in messages:
            if m is not None and m.temporary:
                try:
                    files.delete_file(m.temporary)
                except FileNotFoundError:
                    pass


class BsonArrowWriter(BsonWriter, DataSourceArrowWriter):
    """The same files, whose documents are made of a batch's columns at once."""

    def __init__(self, options: dict, overwrite: bool, schema: T.StructType):
        super().__init__(options, overwrite)
        self.schema = schema

    def _encoded(self, iterator) -> Iterator[Any]:
        for batch in iterator:
            pieces = [batch]
            while pieces:
                piece = pieces.pop()
                if piece.num_rows > 1 and piece.nbytes > BATCH_BYTES:
                    half = piece.num_rows // 2
                    pieces += [piece.slice(half), piece.slice(0, half)]
                elif piece.num_rows:
                    yield _encode_batch(piece, self.schema)


_COLUMNS = (*_FAST, T.DateType, T.NullType)


def _columnar(kind: T.DataType) -> bool:
    """Whether values of a type are the same from Arrow as from rows."""
    if isinstance(kind, T.StructType):
        return len(set(kind.names)) == len(kind.names) and all(_columnar(f.dataType) for f in kind.fields)
    return _columnar(kind.elementType) if isinstance(kind, T.ArrayType) else type(kind) in _COLUMNS


def _encode_batch(batch, schema: T.StructType) -> memoryview:
    """The documents of a batch's rows, without their null fields; nested values are made one by one."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    parts: list = []

    def raw(numbers: Any) -> Any:
        return numbers.view(pa.binary(numbers.type.bit_width // 8)).cast(pa.binary())

    def fixed(value: bytes, col: Any) -> Any:
        """These bytes in each row that has a value."""
        return pa.scalar(value) if not col.null_count else pc.if_else(col.is_valid(), pa.scalar(value), pa.scalar(None, pa.binary()))

    for f, col in zip(schema.fields, batch.columns):
        name, kind = _name(f.name), type(f.dataType)
        if col.null_count == len(col):
            continue
        if kind in _INTEGERS:
            col = col.cast(pa.int64())
            least, most = (x.as_py() for x in pc.min_max(col).values())
            if -(2**31) <= least and most < 2**31:
                parts += [fixed(b"\x10" + name, col), raw(col.cast(pa.int32()))]
            else:
                small = pc.and_(pc.greater_equal(col, -(2**31)), pc.less(col, 2**31))
                parts += [pc.if_else(small, pa.scalar(b"\x10" + name), pa.scalar(b"\x12" + name)), pc.if_else(small, raw(col.cast(pa.int32(), safe=False)), raw(col))]
        elif kind in (T.FloatType, T.DoubleType):
            parts += [fixed(b"\x01" + name, col), raw(col.cast(pa.float64()))]
        elif kind is T.BooleanType:
            parts += [fixed(b"\x08" + name, col), pc.if_else(col, pa.scalar(b"\1"), pa.scalar(b"\0"))]
        elif kind in (T.TimestampType, T.TimestampNTZType, T.DateType):
            there = np.asarray(col.is_valid())
            if kind is T.DateType:
                millis = np.asarray(col.cast(pa.int32()).fill_null(0)).astype(np.int64) * 86_400_000
            else:
                millis = np.asarray(col.cast(pa.int64()).fill_null(0)) // 1000
            parts += [fixed(b"\x09" + name, col), raw(pa.array(millis, pa.int64(), mask=~there))]
        elif kind is T.StringType:
            col = col.cast(pa.binary())
            parts += [fixed(b"\x02" + name, col), raw(pc.add(pc.binary_length(col), pa.scalar(1, pa.int32()))), col, fixed(b"\0", col)]
        elif kind is T.BinaryType:
            col = col.cast(pa.binary())
            parts += [fixed(b"\x05" + name, col), raw(pc.binary_length(col)), fixed(b"\0", col), col]
        else:
            made = [None if v is None else _element(v) for v in col.to_pylist()]
            parts.append(pa.array([None if m is None else bytes(m[:1]) + name + m[1] for m in made], pa.binary()))
    sizes = np.full(batch.num_rows, 5, np.int64)
    for p in parts:
        sizes += len(p.as_py()) if isinstance(p, pa.Scalar) else np.asarray(pc.binary_length(p).fill_null(0))
    if sizes.max() >= 2**31:
        raise ValueError("a document is larger than BSON can hold")
    heads = raw(pa.array(sizes.astype(np.int32)))
    whole = pc.binary_join_element_wise(heads, *parts, pa.scalar(b"\0"), pa.scalar(b""), null_handling="replace", null_replacement=b"")
    return memoryview(whole.buffers()[2])[: int(sizes.sum())]


def _unrow(v: Any) -> Any:
    from pyspark.sql import Row

    if isinstance(v, Row):
        return {k: _unrow(x) for k, x in v.asDict().items()}
    return [_unrow(x) for x in v] if isinstance(v, (list, tuple)) else v


class BsonSource(DataSource):
    """``spark.read.format("vellum-bson").schema(...).load(folder)`` and the like for writing."""

    @classmethod
    def name(cls) -> str:
        return "vellum-bson"

    def schema(self) -> str:
        return "document string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return BsonReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return BsonArrowWriter(dict(self.options), overwrite, schema) if _columnar(schema) else BsonWriter(dict(self.options), overwrite)


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path.rstrip("/"))


def list_files(path: str, ends: tuple[str, ...]) -> list[str]:
    from pyarrow import fs

    files, root = _open(path)
    scheme = path[: len(path) - len(root)] if path.endswith(root) else ""
    info = files.get_file_info(root)
    if info.type == fs.FileType.File:
        return [path]
    found = files.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(scheme + f.path for f in found if f.type == fs.FileType.File and f.path.endswith(ends) and not f.base_name.startswith("."))


def register(spark) -> None:
    from vellum.shipping import ship

    ship(spark)
    spark.dataSource.register(BsonSource)
