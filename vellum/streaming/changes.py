"""Change events made of oplog entries, for tables and streams alike, and windows over event streams.

An event: _id (resume token), operationType, ns {db, coll}, documentKey, fullDocument (JSON; of inserts and updates),
updateDescription {updatedFields, removedFields} (of updates that are deltas), clusterTime. A token is base64 of
"ts:c", so that events of the same second resume exactly.

An update's entry holds the whole row (as this engine's own do), or a delta: {$set, $unset} and, in logs of which all updates are
deltas (``deltas=True``), bare fields, which are set. The modes of fullDocument for updates: ``default``, the row that the entry
holds, if it holds one; ``off``, none; ``updateLookup`` and ``whenAvailable``, the row as it is now, null where it is gone;
``required``, the same, and an error where it is gone.
"""

from __future__ import annotations

import base64
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.errors import SpecError
from vellum.functions.filters import compile_filter
from vellum.functions.paths import Scope

_OPS = {"i": "insert", "u": "update", "d": "delete"}


def token(ts: int, c: int) -> str:
    return base64.b64encode(f"{ts}:{c}".encode()).decode()


def place_of(resume: str) -> tuple[int, int]:
    try:
        ts, c = base64.b64decode(resume, validate=True).decode().split(":")
        return int(ts), int(c)
    except ValueError as e:
        raise SpecError(f"no resume token: {resume!r}") from e


MODES = ("default", "off", "updateLookup", "whenAvailable", "required")


def _fields(o: Column) -> tuple[Column, Column]:
    """(JSON of the fields that a delta sets, names of those that it removes)."""
    kind = "map<string,variant>"
    none = F.from_json(F.lit("{}"), kind)
    named = F.coalesce(F.from_json(F.get_json_object(o, "$['$set']"), kind), none)
    bare = F.map_filter(F.coalesce(F.from_json(o, kind), none), lambda k, v: ~k.isin("$set", "$unset") & ~F.map_contains_key(named, k))
    removed = F.map_keys(F.from_json(F.get_json_object(o, "$['$unset']"), "map<string,string>"))
    return F.to_json(F.map_concat(named, bare)), F.coalesce(removed, F.array().cast("array<string>"))


def events(
    log: DataFrame, ns: str | None = None, database: str | None = None, match: dict | None = None, resumeAfter: str | None = None, startAtOperationTime: int | None = None,
    full_document: DataFrame | None = None, key: str = "_id", mode: str | None = None, deltas: bool = False,
) -> DataFrame:
    """Change events of a collection, a database or all; ``match`` is a filter over the events.

    full_document: the collection as it is now, for the modes that look updates' rows up; given alone, it means updateLookup.
    """
    mode = mode or ("default" if full_document is None else "updateLookup")
    if mode not in MODES or (full_document is None and mode not in ("default", "off")):
        raise SpecError(f"fullDocument is one of {MODES}; all but the first two need the collection")
    rows = log.filter(F.col("op").isin(*_OPS))
    if ns is not None:
        rows = rows.filter(F.col("ns") == ns)
    if database is not None:
        rows = rows.filter(F.startswith("ns", F.lit(database + ".")))
    if resumeAfter is not None:
        ts, c = place_of(resumeAfter)
        rows = rows.filter((F.col("ts") > ts) | ((F.col("ts") == ts) & (F.col("c") > c)))
    if startAtOperationTime is not None:
        rows = rows.filter(F.col("ts") >= startAtOperationTime)
    name = F.lit(None).cast("string")
    for op, word in _OPS.items():
        name = F.when(F.col("op") == op, word).otherwise(name)
    delta = F.lit(deltas) | F.get_json_object("o", "$['$set']").isNotNull() | F.get_json_object("o", "$['$unset']").isNotNull()
    updated, removed = _fields(F.col("o"))
    change = F.struct(updated.alias("updatedFields"), removed.alias("removedFields"))
    document = F.when(F.col("op") == "i", F.col("o"))
    if mode == "default":
        document = document.when((F.col("op") == "u") & ~delta, F.col("o"))
    elif mode != "off":
        now = full_document.select(F.col(key).cast("string").alias("__id"), F.to_json(F.struct("*")).alias("__now"))
        rows = rows.join(now, F.col("id") == F.col("__id"), "left")
        there = F.col("__now")
        if mode == "required":
            there = F.coalesce(there, F.raise_error(F.concat(F.lit("no row for the update of "), F.col("id"))))
        document = document.when(F.col("op") == "u", there)
    split = F.instr("ns", ".")
    out = rows.select(
        F.base64(F.concat_ws(":", F.col("ts").cast("string"), F.col("c").cast("string")).cast("binary")).alias("_id"),
        name.alias("operationType"),
        F.struct(F.substring(F.col("ns"), F.lit(1), split - 1).alias("db"), F.substring(F.col("ns"), split + 1, F.length("ns")).alias("coll")).alias("ns"),
        F.col("o2").alias("documentKey"),
        document.alias("fullDocument"),
        F.when((F.col("op") == "u") & delta, change).alias("updateDescription"),
        (F.col("ts") * 1000).alias("clusterTime"),
    )
    return out.filter(compile_filter(match, Scope.of(out))) if match else out


class Watch:
    """A change stream for a driver: polls an oplog folder's entries in order, from a token on."""

    def __init__(self, log: Callable[[], DataFrame], batch: int = 1000, mode: str = "default", now: Callable[[], DataFrame] | None = None, **options: Any):
        self._log, self._batch, self._mode, self._now, self._options = log, batch, mode, now, options
        self.resume_token: str | None = options.pop("resumeAfter", None)
        self._held: list[dict] = []

    def try_next(self) -> list[dict]:
        """The next events, at most a batch of them; empty if there are none."""
        look = {"mode": self._mode} | ({} if self._mode in ("default", "off") or self._now is None else {"full_document": self._now()})
        options = self._options | look
        match, start = options.pop("match", None), options.pop("startAtOperationTime", None)
        rows = self._log().filter(F.col("op").isin(*_OPS))
        for name, holds in (("ns", lambda x: F.col("ns") == x), ("database", lambda x: F.startswith("ns", F.lit(x + ".")))):
            if options.get(name) is not None:
                rows = rows.filter(holds(options[name]))
        while True:
            part = rows
            if self.resume_token is not None:
                ts, c = place_of(self.resume_token)
                part = part.filter((F.col("ts") > ts) | ((F.col("ts") == ts) & (F.col("c") > c)))
            elif start is not None:
                part = part.filter(F.col("ts") >= start)
            # The oldest entries: a top-k, not a sort of all.
            part = part.orderBy("ts", "c").limit(self._batch)
            found = events(part, **options)
            order = F.split(F.unbase64("_id").cast("string"), ":").cast("array<long>")
            keep = compile_filter(match, Scope.of(found)) if match else F.lit(True)
            out = [r.asDict(recursive=True) for r in found.withColumn("__keep", keep).orderBy(order).collect()]  # a batch
            if out:
                self.resume_token = out[-1]["_id"]
            kept = [r for r in out if r.pop("__keep")]
            if kept or len(out) < self._batch:
                return kept

    def next(self, wait: float = 1.0, timeout: float | None = None) -> dict:
        """The next event, waited for; TimeoutError after ``timeout`` seconds without one."""
        until = None if timeout is None else time.monotonic() + timeout
        while not self._held:
            self._held = self.try_next()
            if not self._held:
                if until is not None and time.monotonic() >= until:
                    raise TimeoutError("no event")
                time.sleep(wait)
        return self._held.pop(0)

    def __iter__(self) -> Iterator[dict]:
        while batch := self.try_next():
            yield from batch


def write_events(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], available_now: bool = True, **options: Any) -> StreamingQuery:
    """Starts a query that hands each micro-batch of events to ``sink``."""
    writer = events(stream, **options).writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(stream: DataFrame, time: str, by: str, size: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Extension: counts by window of event time and a key; rows later than ``late`` are dropped on a stream."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(window.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")
