"""The API: databases and collections over folders of Parquet, with an oplog.

    engine = Engine(spark, "file:///data/store")
    people = engine.database("shop").collection("people")
    people.insert(rows)                       # a DataFrame, or dicts with a schema
    people.find({"age": {"$gt": 30}}, sort={"name": 1}, limit=10)
    people.aggregate([{"$group": {"_id": "$city", "n": {"$sum": 1}}}])

A collection is a folder of versions and of numbered commits, of which the last is the current one. A write makes a new version and
its oplog entries, then creates the next commit's file, which fails if it is there: of two writers that began with the same
rows one succeeds, the other raises ConflictError, and readers see the old or the new rows and never a part. After that the
entries' files are moved to the oplog; a writer that is lost before that has them moved by the next one. ``Transaction`` runs
several steps on one state of the rows, and tries again from the start when it meets a conflict.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import time
import uuid
from collections.abc import Callable, Iterable
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.errors import ConflictError, DuplicateKeyError, SpecError
from vellum.functions.filters import compile_filter
from vellum.functions.paths import Scope
from vellum.operators import find as finding
from vellum.operators import maintenance, updates, validate
from vellum.operators.stages import Context, aggregate
from vellum.sources.bson import _open
from vellum.streaming import changes, oplog

KEEP_VERSIONS = 2
#: Counters of one write's entries in the oplog: inserts from 0, updates and deletes from these on, the next write's from BLOCK on.
UPDATES, DELETES, BLOCK = 1 << 40, 1 << 41, 1 << 42
TRIES = 5


class Engine:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def database(self, name: str) -> "Database":
        return Database(self, name)

    def list_databases(self) -> list[str]:
        return _folders(self.root)

    def server_status(self) -> dict:
        """Databases and collections of this store, and the load of the session that serves it."""
        names = {d: self.database(d).list_collections() for d in self.list_databases()}
        return {"databases": len(names), "collections": sum(map(len, names.values())), "operations": len(self.current_op()), "version": self.spark.version, "parallelism": self.spark.sparkContext.defaultParallelism}

    def current_op(self) -> list[dict]:
        """The jobs that run just now: opid, stages, tasks and those that are done."""
        tracker, out = self.spark.sparkContext.statusTracker(), []
        for job in tracker.getActiveJobsIds():
            info = tracker.getJobInfo(job)
            stages = [x for i in (info.stageIds if info else []) if (x := tracker.getStageInfo(i)) is not None]
            out.append({"opid": job, "stages": len(stages), "tasks": sum(x.numTasks for x in stages), "done": sum(x.numCompletedTasks for x in stages)})
        return out

    def run_as(self, opid: str, f: Callable[[], Any]) -> Any:
        """``f()``, whose jobs ``kill_op`` can end under this name."""
        self.spark.sparkContext.setJobGroup(opid, opid, interruptOnCancel=True)
        try:
            return f()
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    def kill_op(self, opid: str) -> None:
        """Ends the jobs of an operation that was begun by ``run_as``."""
        self.spark.sparkContext.cancelJobGroup(opid)


class Database:
    def __init__(self, engine: Engine, name: str):
        if not name or "/" in name or "." in name:
            raise SpecError(f"no database name: {name!r}")
        self.engine, self.name = engine, name
        self.path = f"{engine.root}/{name}"

    def collection(self, name: str) -> "Collection":
        return Collection(self, name)

    def list_collections(self) -> list[str]:
        return [c for c in _folders(self.path) if not c.startswith("_")]

    def drop(self) -> None:
        _delete(self.path)

    def watch(self, **options: Any) -> changes.Watch:
        return changes.Watch(self.oplog, database=self.name, **options)

    def oplog(self) -> DataFrame:
        """All entries, those of a commit whose writer was lost before it moved them too."""
        for name in self.list_collections():
            self.collection(name)._recover()
        path = f"{self.path}/_oplog"
        spark = self.engine.spark
        return spark.read.schema(oplog.SCHEMA).parquet(path) if _exists(path) else spark.createDataFrame([], oplog.SCHEMA)

    def truncate_oplog(self, ts: int) -> None:
        """Entries before a second are gone, files and all: files of only later entries stay as they are."""
        path, spark = f"{self.path}/_oplog", self.engine.spark
        if not _exists(path):
            return
        log = self.oplog()
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)
        old = [r[0] for r in log.filter(F.col("ts") < ts).select(name).distinct().toLocalIterator()]
        if not old:
            return
        kept = f"{self.path}/_oplog_kept_{uuid.uuid4().hex}"
        log.filter(name.isin(*old)).filter(F.col("ts") >= ts).write.parquet(kept)
        _move_files(kept, path)
        files, root = _open(path)
        for f in old:
            files.delete_file(f"{root}/{f}")
        _delete(kept)

    def _next_place(self) -> tuple[int, int]:
        """(second, first counter) of the next write's entries: after all that were given before, whatever the clock says."""
        held = _last_of(f"{self.path}/_places")
        now = int(time.time())
        ts, c = (0, 0) if held is None else tuple(map(int, held.split("-")))
        place = (now, 0) if now > ts else (ts, c + BLOCK)
        while not _create(f"{self.path}/_places/{place[0]:012d}-{place[1]:020d}", ""):
            place = (place[0], place[1] + BLOCK)
        if held is not None:
            _drop_file(f"{self.path}/_places/{held}")
        return place

    def create(self, name: str, **options: Any) -> "Collection":
        """A new collection; one that is there is an error."""
        if name in self.list_collections():
            raise SpecError(f"{self.name}.{name} is there already")
        made = self.collection(name)
        made.create(**options)
        return made

    def stats(self) -> dict:
        rows = [self.collection(c).stats().first() for c in self.list_collections()]
        return {"collections": len(rows), "objects": sum(r["count"] for r in rows), "dataSize": sum(r["size"] for r in rows)}


class Collection:
    """Rows with a key column, read lazily, written as whole versions."""

    def __init__(self, database: Database, name: str):
        if not name or "/" in name or name.startswith("_"):
            raise SpecError(f"no collection name: {name!r}")
        self.database, self.name = database, name
        self.path = f"{database.path}/{name}"
        self.ns = f"{database.name}.{name}"

    # --- reading ---

    def _meta(self) -> dict:
        name = _last_of(f"{self.path}/_commits")
        raw = _read(f"{self.path}/_commits/{name}") if name else None
        return json.loads(raw) if raw else {"commit": 0, "version": None, "key": "_id", "indexes": [], "options": {}}

    def _put(self, meta: dict) -> None:
        """Makes this state the current one, if nobody has changed it since it was read."""
        n = meta["commit"] + 1
        if not _create(f"{self.path}/_commits/{n:012d}", json.dumps(meta | {"commit": n})):
            raise ConflictError(self.ns)
        if n > KEEP_VERSIONS:
            _drop_file(f"{self.path}/_commits/{n - KEEP_VERSIONS:012d}")

    def _recover(self) -> None:
        """Moves the current version's entries to the oplog, if their writer hasn't."""
        version = self._meta()["version"]
        if version and _exists(staged := f"{self.path}/_log-{version}"):
            _move_files(staged, f"{self.database.path}/_oplog")
            _delete(staged)

    def rows(self) -> DataFrame:
        meta = self._meta()
        if meta["version"] is None:
            return self.database.engine.spark.createDataFrame([], T.StructType([T.StructField(meta["key"], T.StringType())]))
        schema = T.StructType.fromJson(meta["schema"])
        return self.database.engine.spark.read.schema(schema).parquet(f"{self.path}/{meta['version']}")

    def context(self) -> Context:
        return Context(collection=lambda n: self.database.collection(n).rows(), key=self._meta()["key"], oplog=lambda: self.database.oplog().filter(F.col("ns") == self.ns))

    def find(self, filter: dict | None = None, projection: dict | None = None, sort: dict | None = None, skip: int = 0, limit: int = 0) -> DataFrame:
        return finding.find(self.rows(), filter, projection, sort, skip, limit, key=self._meta()["key"])

    def find_one(self, filter: dict | None = None, projection: dict | None = None) -> dict | None:
        row = self.find(filter, projection, limit=1).first()
        return None if row is None else row.asDict(recursive=True)

    def cursor(self, batch: int = 101, **query: Any) -> Iterable[list[dict]]:
        """The rows of a find in batches, fetched partition by partition."""
        rows = self.find(**query).toLocalIterator()
        while part := [r.asDict(recursive=True) for r in islice(rows, batch)]:
            yield part

    def count(self, filter: dict | None = None) -> int:
        return finding.count(self.rows(), filter).first()["n"]

    def distinct(self, path: str, filter: dict | None = None) -> DataFrame:
        return finding.distinct(self.rows(), path, filter)

    def aggregate(self, pipeline: list[dict]) -> DataFrame:
        return aggregate(self.rows(), pipeline, self.context())

    def explain(self, filter: dict | None = None, sort: dict | None = None, run: bool = True, **query: Any) -> dict:
        """How a find is done: the filter with its implicit equalities written out, the stage, what was examined and returned.

        A partial or ordered index never changes what is read here, so the stage is IXSCAN only where an index's first field is
        tested for equality and the version's files are arranged by it (``arrange``); Parquet statistics then skip the rest.
        """
        meta, rows = self._meta(), self.rows()
        found = self.find(filter, sort=sort, **query)
        parsed = {k: v if k.startswith("$") or isinstance(v, dict) else {"$eq": v} for k, v in (filter or {}).items()}
        by = meta.get("arranged")
        used = by and any(k in (filter or {}) and set(parsed[k]) & {"$eq", "$in", "$gt", "$gte", "$lt", "$lte"} for k in by[:1])
        ix = next((i for i in meta["indexes"] if used and i["fields"] == by), None)
        plan: dict[str, Any] = {"stage": "EOF" if meta["version"] is None else "IXSCAN" if ix else "COLLSCAN", "direction": "forward"}
        if ix:
            plan["indexName"] = ix["name"]
            if sort and list(sort) == ix["fields"][: len(sort)] and list(sort.values()) == ix["kinds"][: len(sort)]:
                plan["sortPattern"] = sort
        mode = self.database.engine.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        out = {"queryPlanner": {"namespace": self.ns, "parsedQuery": parsed, "winningPlan": plan, "rejectedPlans": []}, "physical": found._jdf.queryExecution().explainString(mode)}
        if run:
            began = time.monotonic()
            match = F.lit(True) if not filter else F.coalesce(compile_filter(filter, Scope.of(rows)), F.lit(False))
            row = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(match).alias("hit")).first()
            examined = row["hit"] if ix else row["n"]
            out["executionStats"] = {"nReturned": row["hit"], "totalKeysExamined": row["hit"] if ix else 0, "totalDocsExamined": examined, "executionTimeMillis": int((time.monotonic() - began) * 1000)}
        return out

    def stats(self) -> DataFrame:
        return maintenance.stats(self.rows())

    # --- writing ---

    def create(self, key: str = "_id", validator: dict | None = None, action: str = "error", capped: dict | None = None) -> None:
        """Sets the key, a validator, and for a capped collection {max_docs, max_size}."""
        self._put(self._meta() | {"key": key, "options": {"validator": validator, "action": action, "capped": capped}})

    def modify(self, validator: dict | None = None, action: str | None = None, index: dict | None = None, max_docs: int | None = None, max_size: int | None = None) -> None:
        """Changes what is given: the validator, what breaking it does, {name, expireAfterSeconds} of an index, a capped size."""
        meta = self._meta()
        options = dict(meta["options"])
        options |= {k: v for k, v in (("validator", validator), ("action", action)) if v is not None}
        if max_docs is not None or max_size is not None:
            if not options.get("capped"):
                raise SpecError(f"{self.ns} isn't capped")
            options["capped"] = options["capped"] | {k: v for k, v in (("max_docs", max_docs), ("max_size", max_size)) if v is not None}
        indexes = meta["indexes"]
        if index is not None:
            if index.get("name") not in {i["name"] for i in indexes}:
                raise SpecError(f"no index {index.get('name')!r}")
            indexes = [i | {"expireAfterSeconds": index["expireAfterSeconds"]} if i["name"] == index["name"] else i for i in indexes]
        self._put(meta | {"options": options, "indexes": indexes})

    def _commit(self, meta: dict, rows: DataFrame, log: Callable[[DataFrame], DataFrame] | None, **more: Any) -> None:
        """Writes a version and makes it the current one; ``log`` makes the entries, given the version's rows."""
        options, spark = meta["options"], self.database.engine.spark
        self._recover()
        if options.get("capped"):
            rows = maintenance.capped(rows, key=meta["key"], **options["capped"])
        version = f"v{dt.datetime.now(dt.timezone.utc):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"
        staged = f"{self.path}/_log-{version}"
        try:
            rows.write.parquet(f"{self.path}/{version}")
            written = spark.read.schema(rows.schema).parquet(f"{self.path}/{version}")
            for ix in meta["indexes"]:
                if ix.get("unique") and maintenance.unique_violations(written, ix["fields"], ix.get("sparse", False), ix.get("partial")).limit(1).count():
                    raise DuplicateKeyError(f"{self.ns} {ix['name']}")
            if log is not None:
                log(written).write.parquet(staged)
            old = [*meta.get("old", []), *([meta["version"]] if meta["version"] else [])]
            self._put({"arranged": None} | meta | {"version": version, "schema": rows.schema.jsonValue(), "old": old[-KEEP_VERSIONS:]} | more)
        except BaseException:
            _delete(f"{self.path}/{version}")
            _delete(staged)
            raise
        self._recover()
        for gone in old[:-KEEP_VERSIONS]:
            _delete(f"{self.path}/{gone}")

    def _entries(self, made: DataFrame | None, changed: DataFrame | None, gone: DataFrame | None, meta: dict) -> DataFrame:
        """The oplog entries of a write, at places after all that were given before."""
        ts, c = self.database._next_place()
        at = dt.datetime.fromtimestamp(ts, dt.timezone.utc)
        parts = [oplog.entries(rows, op, self.ns, at, meta["key"], c + start) for rows, op, start in ((made, "i", 0), (changed, "u", UPDATES), (gone, "d", DELETES)) if rows is not None]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def insert(self, rows: DataFrame | list[dict], schema: T.StructType | str | None = None) -> None:
        """Adds rows; those whose key is there already take its place, of equal keys the last counts. A missing key is made up."""
        meta, spark = self._meta(), self.database.engine.spark
        new = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, schema)
        key = meta["key"]
        if key not in new.columns:
            new = new.withColumn(key, F.expr("replace(uuid(), '-', '')"))
        validator = meta["options"].get("validator")
        if validator:
            if meta["options"].get("action") == "error" and validate.violations(new, validator).limit(1).count():
                raise SpecError(f"rows break the validator of {self.ns}")
        there = self.rows()
        new = updates.last_of_each(new, key)
        every = new if meta["version"] is None else updates.insert(there, new, key)
        self._commit(meta, every, lambda written: self._entries(new, None, None, meta))

    def update(self, filter: dict, change: dict, multi: bool = False, upsert: bool = False, key_value: Any = None) -> None:
        meta, before, now = self._meta(), self.rows(), dt.datetime.now(dt.timezone.utc)
        key = meta["key"]
        if upsert and key_value is None and (key not in before.columns or isinstance(before.schema[key].dataType, T.StringType)):
            key_value = uuid.uuid4().hex
        after = updates.update(before, filter, change, multi, upsert, key, key_value, now)
        changed = updates.changed(before, filter, change, multi, key, now)
        made = updates.upserted(before, filter, change, key, key_value, now) if upsert else None
        self._commit(meta, after, lambda written: self._entries(made, changed, None, meta))

    def update_one(self, filter: dict, change: dict, upsert: bool = False) -> None:
        self.update(filter, change, False, upsert)

    def update_many(self, filter: dict, change: dict, upsert: bool = False) -> None:
        self.update(filter, change, True, upsert)

    def replace_one(self, filter: dict, row: dict, upsert: bool = False) -> None:
        if any(k.startswith("$") for k in row):
            raise SpecError("a replacement has no operators")
        self.update(filter, row, False, upsert)

    def delete(self, filter: dict, multi: bool = True) -> None:
        meta = self._meta()
        if meta["options"].get("capped"):
            raise SpecError("rows of a capped collection can't be deleted")
        before = self.rows()
        gone = updates.deleted(before, filter, multi, meta["key"])
        self._commit(meta, updates.delete(before, filter, multi, meta["key"]), lambda written: self._entries(None, None, gone, meta))

    def arrange(self, index: str, partitions: int | None = None) -> None:
        """Rewrites the rows in the order of an index's fields, so that its range scans skip files and row groups."""
        meta = self._meta()
        ix = next((i for i in meta["indexes"] if i["name"] == index), None)
        if ix is None:
            raise SpecError(f"no index {index!r}")
        self._commit(meta, maintenance.layout(self.rows(), ix["fields"], partitions), None, arranged=ix["fields"])

    def find_and_modify(self, filter: dict, **options: Any) -> dict | None:
        meta = self._meta()
        before = self.rows()
        options = {"now": dt.datetime.now(dt.timezone.utc), "key_value": uuid.uuid4().hex if options.get("upsert") else None} | options
        after, value = updates.find_and_modify(before, filter, key=meta["key"], **options)
        row = value.first()
        self._commit_change(meta, before, after)
        return None if row is None else row.asDict(recursive=True)

    def _commit_change(self, meta: dict, before: DataFrame, after: DataFrame) -> None:
        """Commits the rows after any change, and logs what differs from before."""
        key = meta["key"]

        def log(written: DataFrame) -> DataFrame:
            was = before.select(F.col(key).alias("__k"), F.xxhash64(F.to_json(F.struct("*"))).alias("__h"))
            now = written.withColumn("__h2", F.xxhash64(F.to_json(F.struct("*"))))
            joined = now.join(was, now[key].eqNullSafe(F.col("__k")), "left")
            made, changed = joined.filter("__h is null").select(*after.columns), joined.filter("__h <> __h2").select(*after.columns)
            gone = before.select(key).join(written.select(F.col(key).alias("__k")), F.col(key).eqNullSafe(F.col("__k")), "left_anti")
            return self._entries(made, changed, gone, meta)

        self._commit(meta, after, log)

    def drop(self) -> None:
        _delete(self.path)

    # --- indexes and streams ---

    def create_index(self, fields: dict[str, Any], unique: bool = False, sparse: bool = False, partial: dict | None = None, expire_after: int = 0, name: str | None = None) -> str:
        """Registers an index: it never changes results; a unique one is checked now and at each write, a date one expires."""
        meta = self._meta()
        bad = [v for v in fields.values() if v not in (1, -1, "hashed", "text", "2dsphere")]
        if bad:
            raise SpecError(f"unknown kinds of index: {bad}")
        ix = {"name": name or "_".join(f"{k}_{v}" for k, v in fields.items()), "fields": list(fields), "kinds": list(fields.values()), "unique": unique, "sparse": sparse, "partial": partial, "expireAfterSeconds": expire_after}
        if unique and maintenance.unique_violations(self.rows(), ix["fields"], sparse, partial).limit(1).count():
            raise DuplicateKeyError(f"{self.ns} {ix['name']}")
        self._put(meta | {"indexes": [i for i in meta["indexes"] if i["name"] != ix["name"]] + [ix]})
        return ix["name"]

    def drop_index(self, name: str) -> None:
        meta = self._meta()
        self._put(meta | {"indexes": [i for i in meta["indexes"] if i["name"] != name]})

    def list_indexes(self) -> list[dict]:
        return self._meta()["indexes"]

    def expire(self, now: dt.datetime) -> None:
        """Deletes what the expiring indexes let go at ``now``."""
        meta, before = self._meta(), self.rows()
        after = before
        for ix in meta["indexes"]:
            if ix["expireAfterSeconds"] > 0:
                after = maintenance.expire(after, ix["fields"][0], ix["expireAfterSeconds"], now)
        self._commit_change(meta, before, after)

    def partial_copy(self, name: str) -> DataFrame:
        """The rows of a partial index, in the order of its fields."""
        ix = next(i for i in self._meta()["indexes"] if i["name"] == name)
        rows = self.rows()
        rows = rows.filter(compile_filter(ix["partial"], Scope.of(rows))) if ix["partial"] else rows
        return maintenance.layout(rows, ix["fields"])

    def watch(self, fullDocument: str = "default", **options: Any) -> changes.Watch:
        """A change stream; ``fullDocument``: default, off, whenAvailable, required or updateLookup."""
        return changes.Watch(self.database.oplog, ns=self.ns, mode=fullDocument, now=self.rows, key=self._meta()["key"], **options)

    def transaction(self, *steps: Callable[[DataFrame], DataFrame]) -> None:
        """Several changes of the rows, committed as one version or not at all."""

        def run(t: Transaction) -> None:
            for step in steps:
                t.rows = step(t.rows)

        self.with_transaction(run)

    def with_transaction(self, run: Callable[["Transaction"], Any], tries: int = TRIES) -> Any:
        """``run`` with a transaction, committed at its end; again from the start, at most ``tries`` times, after a conflict."""
        for left in range(tries - 1, -1, -1):
            t = Transaction(self)
            out = run(t)
            try:
                if t.open:
                    t.commit()
                return out
            except ConflictError:
                if not left:
                    raise


class Transaction:
    """Steps on the rows as they were at its beginning, each seeing those before it; nothing is written before ``commit``."""

    def __init__(self, collection: Collection):
        self.collection, self.meta, self.before = collection, collection._meta(), collection.rows()
        self.rows, self.open, self.now = self.before, True, dt.datetime.now(dt.timezone.utc)

    def find(self, filter: dict | None = None, projection: dict | None = None, sort: dict | None = None, skip: int = 0, limit: int = 0) -> DataFrame:
        return finding.find(self.rows, filter, projection, sort, skip, limit, key=self.meta["key"])

    def find_one(self, filter: dict | None = None) -> dict | None:
        row = self.find(filter, limit=1).first()
        return None if row is None else row.asDict(recursive=True)

    def insert(self, rows: DataFrame | list, schema: T.StructType | str | None = None) -> None:
        new = rows if isinstance(rows, DataFrame) else self.collection.database.engine.spark.createDataFrame(rows, schema)
        new = updates.last_of_each(new, self.meta["key"])
        self.rows = new if self.meta["version"] is None and self.rows is self.before else updates.insert(self.rows, new, self.meta["key"])

    def update(self, filter: dict, change: dict, multi: bool = False, upsert: bool = False, key_value: Any = None) -> None:
        key_value = uuid.uuid4().hex if upsert and key_value is None else key_value
        self.rows = updates.update(self.rows, filter, change, multi, upsert, self.meta["key"], key_value, self.now)

    def delete(self, filter: dict, multi: bool = True) -> None:
        self.rows = updates.delete(self.rows, filter, multi, self.meta["key"])

    def commit(self) -> None:
        if not self.open:
            raise SpecError("the transaction is over")
        self.open = False
        if self.rows is not self.before:
            self.collection._commit_change(self.meta, self.before, self.rows)

    def abort(self) -> None:
        self.open, self.rows = False, self.before


# --- files -----------------------------------------------------------------------------------------------------------


def _folders(path: str) -> list[str]:
    from pyarrow import fs

    files, root = _open(path)
    if files.get_file_info(root).type != fs.FileType.Directory:
        return []
    return sorted(f.base_name for f in files.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory)


def _exists(path: str) -> bool:
    from pyarrow import fs

    files, root = _open(path)
    return files.get_file_info(root).type != fs.FileType.NotFound


def _read(path: str) -> bytes | None:
    if not _exists(path):
        return None
    files, root = _open(path)
    with files.open_input_file(root) as f:
        return f.read()


def _create(path: str, text: str) -> bool:
    """Creates a file with this text, whole or not at all; False if there is one of that name."""
    files, root = _open(path)
    files.create_dir(root.rsplit("/", 1)[0], recursive=True)
    tmp = f"{root.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    with files.open_output_stream(tmp, compression=None) as f:
        f.write(text.encode())
    if files.type_name in ("local", "subtree"):
        try:
            os.link(tmp, root)
            return True
        except FileExistsError:
            return False
        finally:
            files.delete_file(tmp)
    # Hadoop's rename without overwriting is atomic where the file system's is.
    from pyspark.sql import SparkSession

    jvm = SparkSession.active()._jvm
    hadoop = jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    done = target.getFileSystem(SparkSession.active()._jsc.hadoopConfiguration()).rename(hadoop.Path(f"{path.rsplit('/', 1)[0]}/{tmp.rsplit('/', 1)[1]}"), target)
    if not done:
        files.delete_file(tmp)
    return done


def _last_of(path: str) -> str | None:
    """The greatest name of the files in a folder."""
    from pyarrow import fs

    files, root = _open(path)
    return max((f.base_name for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.File and not f.base_name.startswith(".")), default=None)


def _drop_file(path: str) -> None:
    files, root = _open(path)
    try:
        files.delete_file(root)
    except FileNotFoundError:
        pass


def _move_files(source: str, target: str) -> None:
    """Moves a written table's files into another table's folder; those that are moved already stay there."""
    from pyarrow import fs

    files, a = _open(source)
    _, b = _open(target)
    files.create_dir(b, recursive=True)
    for f in files.get_file_info(fs.FileSelector(a)):
        if f.type == fs.FileType.File and f.base_name.endswith(".parquet"):
            files.move(f.path, f"{b}/{f.base_name}")


def _delete(path: str) -> None:
    files, root = _open(path)
    if _exists(path):
        files.delete_dir(root)
