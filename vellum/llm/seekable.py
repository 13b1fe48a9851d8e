"""Token ids as seekable zstandard files: a document a frame, a seek table at the end, a checksum of every frame.

A file is a run of independent zstandard frames, one for each document, and then a skippable frame with the seek table
of the public zstd seekable format: for each frame its compressed size, its size and the low 32 bits of the xxh64 of its
content, then the number of frames, a descriptor and the magic number. Content is little-endian uint16 where the
vocabulary has at most 65,536 ids, else uint32. A reader takes the table from the file's end, seeks, decompresses only the
frames it wants and verifies each.

``write`` is a job of its own: each task attempt writes a file of its partition under a name of its own, and the manifest, a
row for each document, is written as Parquet beside the files. Only the manifest rows of attempts that Spark commits are
kept, and each names its attempt's file, complete before its task ends; the files of other attempts are removed at the
end. What is returned is the written manifest: to read it again, or a part of it, writes nothing.

Defined results: a null text gives an empty frame and n_tokens null, an empty text an empty frame and n_tokens 0; both are
read back as such, null and empty. Very long texts are one frame; repeated rows and rows without an id have frames of their
own, also where ids are equal; other columns don't matter; an empty partition writes no file, an empty table gives an empty
manifest. A damaged frame or seek table raises ValueError when it is read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import PATTERN, VOCABULARY, load
from .common import doc_rows, shared_dir, slices

SKIPPABLE, MAGIC = 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
LEVEL = 3


class Writer:
    """Frames into a file object, then the seek table."""

    def __init__(self, out, level: int = LEVEL):
        self.out, self.entries, self.offset = out, [], 0
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)

    def add(self, content: bytes) -> tuple[int, int, int]:
        """(offset, compressed size, checksum) of the new frame."""
        frame = self.zstd.compress(content)
        check = xxhash.xxh64_intdigest(content) & 0xFFFFFFFF
        self.out.write(frame)
        self.entries.append((len(frame), len(content), check))
        at = self.offset
        self.offset += len(frame)
        return at, len(frame), check

    def close(self) -> None:
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUMS, MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class Reader:
    """Random access to the frames of a seekable file object."""

    def __init__(self, file, size: int):
        self.file = file
        self.zstd = zstandard.ZstdDecompressor()
        if size < 17:
            raise ValueError("no seek table")
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        width = 12 if flags & CHECKSUMS else 8
        if magic != MAGIC or size < 17 + n * width:
            raise ValueError("no seek table")
        file.seek(size - 17 - n * width)
        head = file.read(8 + n * width)
        if struct.unpack("<II", head[:8]) != (SKIPPABLE, n * width + 9):
            raise ValueError("the seek table's frame is damaged")
        e = np.frombuffer(head, "<u4", n * width // 4, 8).reshape(n, width // 4).astype(np.int64)
        self.sizes, self.lengths = e[:, 0], e[:, 1]
        self.checks = e[:, 2] if width == 12 else None
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))

    def __len__(self) -> int:
        return len(self.sizes)

    def frame(self, k: int) -> bytes:
        self.file.seek(int(self.starts[k]))
        try:
            content = self.zstd.decompress(self.file.read(int(self.sizes[k])))
        except zstandard.ZstdError as e:
            raise ValueError(f"frame {k} is damaged") from e
        if len(content) != self.lengths[k] or self.checks is not None and xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.checks[k]:
            raise ValueError(f"frame {k} is damaged")
        return content


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


MANIFEST = "doc_id long, file string, frame int, offset long, size int, n_tokens int, checksum long, width int"


def write(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN, level: int = LEVEL) -> DataFrame:
    """Writes the documents' token ids below ``folder`` and returns the manifest; width: bytes of an id."""
    spark, ranks = docs.sparkSession, load(vocabulary)
    held = spark.sparkContext.broadcast(ranks)
    width = 2 if max(ranks.values()) < 65536 else 4
    job = uuid.uuid4().hex[:12]
    base = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=held.value, special_tokens={}).encode_ordinary
        context = TaskContext.get()
        name = f"{job}-{context.partitionId():06d}-{context.taskAttemptId()}.zst"
        files, root = _open(base)
        out = writer = None
        frame = 0
        for b in (s for whole in batches for s in slices(whole, 1)):
            if writer is None:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(f"{root}/{name}", compression=None)
                writer = Writer(out, level)
            rows: list[tuple] = []
            for text in b.column(1).to_pylist():
                ids = encode(text) if text else []
                at, size, check = writer.add(np.array(ids, f"<u{width}").tobytes())
                rows.append((frame, at, size, None if text is None else len(ids), check, width))
                frame += 1
            cols = list(zip(*rows))
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f"{base}/{name}"] * b.num_rows), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "file", "frame", "offset", "size", "n_tokens", "checksum", "width"])
        if writer is not None:
            writer.close()
            out.close()

    path = f"{base}/{job}-manifest"
    try:
        doc_rows(docs).mapInArrow(run, MANIFEST).write.parquet(path)
    except BaseException:
        _remove(base, job, set())
        raise
    manifest = spark.read.schema(MANIFEST).parquet(path)
    # A name for each task of the job.
    _remove(base, job, {r["file"].rsplit("/", 1)[1] for r in manifest.select("file").distinct().toLocalIterator()})
    return manifest


def _remove(base: str, job: str, keep: set[str]) -> None:
    """Removes the files of a job but those to keep."""
    files, root = _open(base)
    for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if f.type == fs.FileType.File and f.base_name.startswith(f"{job}-") and f.base_name.endswith(".zst") and f.base_name not in keep:
            files.delete_file(f.path)


def read_frames(path: str, frames: Iterable[int], width: int = 2) -> list[np.ndarray]:
    """The token ids, of ``width`` bytes each, of the given frames of a file; no other frame is read."""
    files, name = _open(path)
    with files.open_input_file(name) as f:
        r = Reader(f, f.size())
        return [np.frombuffer(r.frame(k), f"<u{width}") for k in frames]


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, tokens) of the manifest's rows: select the wanted documents there, and only their frames are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, paths, frames, counts, widths = (b.column(k).to_pylist() for k in range(5))
            tokens: list = [None] * len(ids)
            for path in dict.fromkeys(paths):
                at = [i for i, p in enumerate(paths) if p == path and counts[i] is not None]
                if at:
                    for i, t in zip(at, read_frames(path, [frames[i] for i in at], widths[at[0]])):
                        tokens[i] = t.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.list_(pa.int32()))], names=["doc_id", "tokens"])

    return manifest.select("doc_id", "file", "frame", "n_tokens", "width").mapInArrow(run, "doc_id long, tokens array<int>")


def write_shared(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``write`` to a new folder below the shared one."""
    return write(docs, shared_dir(docs.sparkSession), vocabulary)
