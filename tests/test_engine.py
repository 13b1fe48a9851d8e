"""Collections on disk, oplog, change streams, sources, text, variants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.conftest import values
from vellum.engine import Engine
from vellum.errors import ConflictError, DuplicateKeyError, SpecError
from vellum.functions import geo, text, variant
from vellum.sources import backup, bson, gridfs
from vellum.streaming import changes, oplog


@pytest.fixture()
def people(spark, tmp_path):
    c = Engine(spark, str(tmp_path)).database("shop").collection("people")
    c.insert([("1", "Ann", 30), ("2", "Bob", 25)], "_id string, name string, age int")
    return c


def test_crud(people):
    people.update_one({"name": "Ann"}, {"$inc": {"age": 1}})
    people.insert([("3", "Cid", 40), ("2", "Ben", 26)], "_id string, name string, age int")
    people.delete({"_id": "1"})
    assert values(people.find(sort={"_id": 1}), "_id", "name", "age") == [("2", "Ben", 26), ("3", "Cid", 40)]
    assert people.count({"age": {"$gt": 30}}) == 1 and people.find_one({"_id": "9"}) is None
    assert people.find_and_modify({"_id": "3"}, change={"$set": {"age": 41}}, new=True)["age"] == 41
    assert people.aggregate([{"$group": {"_id": None, "s": {"$sum": "$age"}}}]).first()["s"] == 67.0
    assert [len(b) for b in people.cursor(1)] == [1, 1]
    ops = [e["operationType"] for e in people.watch()]
    assert sorted(ops) == ["delete", "insert", "insert", "insert", "insert", "update", "update"]
    assert values(oplog.state(people.database.oplog(), people.rows().schema, people.ns), "_id", "age") == [("2", 26), ("3", 41)]
    people.transaction(lambda d: d.filter("_id <> '3'"), lambda d: d.withColumn("age", F.col("age") + 1))
    assert values(people.rows(), "_id", "age") == [("2", 27)]
    assert people.database.list_collections() == ["people"]
    people.drop()
    assert people.count() == 0


def test_indexes(people):
    people.create_index({"name": 1}, unique=True)
    with pytest.raises(DuplicateKeyError):
        people.insert([("7", "Ann", 1)], "_id string, name string, age int")
    assert people.count() == 2 and len(people.list_indexes()) == 1
    people.drop_index("name_1")
    people.insert([("7", "Ann", 1)], "_id string, name string, age int")
    with pytest.raises(DuplicateKeyError):
        people.create_index({"name": 1}, unique=True)
    name = people.create_index({"age": 1}, partial={"age": {"$gt": 20}})
    assert people.partial_copy(name).count() == 2


def test_validator_and_capped(spark, tmp_path):
    c = Engine(spark, str(tmp_path)).database("d").collection("c")
    c.create(validator={"properties": {"n": {"minimum": 0}}}, capped={"max_docs": 2})
    c.insert([(1, 1), (2, 2), (3, 3)], "_id int, n int")
    assert values(c.rows()) == [(2, 2), (3, 3)]
    with pytest.raises(SpecError):
        c.insert([(4, -1)], "_id int, n int")
    with pytest.raises(SpecError):
        c.delete({})


def test_resume_and_tokens(spark):
    log = spark.createDataFrame([(5, 1, "i", "d.a", "1", '{"_id":1}', '{"_id":1}', 0), (5, 2, "u", "d.a", "1", '{"$set":{"x":2},"$unset":{"y":""}}', '{"_id":1}', 0), (5, 3, "d", "d.b", "2", '{"_id":2}', '{"_id":2}', 0)], oplog.SCHEMA)
    all_ = changes.events(log).orderBy("_id").collect()
    assert [e["operationType"] for e in all_] == ["insert", "update", "delete"]
    assert all_[1]["updateDescription"]["updatedFields"] == '{"x":2}' and all_[1]["updateDescription"]["removedFields"] == ["y"]
    assert [e["operationType"] for e in changes.events(log, resumeAfter=all_[0]["_id"]).orderBy("_id").collect()] == ["update", "delete"]
    assert changes.events(log, ns="d.a").count() == 2 and changes.events(log, database="d").count() == 3
    assert changes.place_of(changes.token(5, 2)) == (5, 2)
    with pytest.raises(SpecError):
        changes.place_of("???")


def test_fold_deltas(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "_id int, s string, n int")
    rows = [(1, 0, "u", "1", '{"$set":{"n":5}}'), (2, 0, "u", "1", '{"$unset":{"s":""},"$set":{"n":6}}'), (3, 0, "d", "2", '{"_id":2}'), (4, 0, "i", "3", '{"_id":3,"s":"c","n":3}'), (5, 0, "u", "3", '{"s":"d"}'), (6, 0, "u", "9", '{"$set":{"n":1}}')]
    log = spark.createDataFrame([(t, c, op, "d.a", i, o, None, 0) for t, c, op, i, o in rows], oplog.SCHEMA)
    assert sorted(map(str, oplog.fold_deltas(base, log, "d.a").collect())) == sorted(["Row(_id=1, s=None, n=6)", "Row(_id=3, s='d', n=3)"])


def test_streaming(spark, tmp_path):
    log = str(tmp_path / "log")
    spark.createDataFrame([(1, 1, "i", "d.a", "1", "{}", "{}", 0), (1, 2, "d", "d.b", "1", "{}", "{}", 0)], oplog.SCHEMA).write.parquet(log)
    got = []
    for _ in range(2):
        q = changes.write_events(oplog.stream(spark, log), str(tmp_path / "cp"), lambda df, i: got.extend(df.select("operationType").collect()), ns="d.a")
        q.awaitTermination(60)
    assert [r[0] for r in got] == ["insert"]


def test_bson(spark, tmp_path):
    doc = {"i": 1, "l": 2**40, "d": 1.5, "s": "é", "n": None, "b": True, "a": [1, "x", {"y": []}], "o": {"k": b"raw"}, "t": dt.datetime(2020, 1, 2, 3, 4, 5, 6000, dt.timezone.utc), "id": bson.ObjectId(bytes(12)), "r": bson.Regex("a", "i"), "ts": bson.Timestamp(7)}
    assert bson.decode(bson.encode(doc)) == doc
    assert [bson.decode(d) for d in bson.documents(bson.encode({"a": 1}) + bson.encode({}))] == [{"a": 1}, {}]
    with pytest.raises(ValueError):
        bson.decode(b"\x06\x00\x00\x00\x00")
    df = spark.createDataFrame([(1, "x", [1, 2], (2.5,)), (2, None, None, None)], "_id int, s string, xs array<int>, d struct<f:double>")
    for form, gzip in (("bson", False), ("bson", True), ("json", False), ("parquet", False)):
        path = str(tmp_path / f"{form}{gzip}")
        sums = backup.write(df, path, form, gzip).first()
        back = backup.read(spark, path, df.schema, form)
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
        assert backup.verify(back, sums["documents"], sums["checksum"])
    log = spark.createDataFrame([(9, 1, "u", "d.a", "1", '{"_id":1,"s":"new"}', None, 0), (9, 2, "d", "d.a", "2", "{}", None, 0), (3, 1, "i", "d.a", "7", "{}", None, 0)], oplog.SCHEMA)
    assert values(backup.restore(df, [backup.increment(log, 5)], "d.a"), "_id", "s") == [(1, "new")]
    assert backup.report(df).first()["repeated_keys"] == 0


def test_gridfs(spark):
    df = spark.createDataFrame([("a", b"0123456789"), ("b", b""), ("c", b"xyz")], "name string, content binary")
    files, chunks = gridfs.split(df, "name", "content", 4)
    assert values(chunks.select("files_id", "n")) == [("a", 0), ("a", 1), ("a", 2), ("c", 0)]
    assert {r["filename"]: (bytes(r["content"]), r["complete"]) for r in gridfs.join(files, chunks).collect()} == {"a": (b"0123456789", True), "b": (b"", True), "c": (b"xyz", True)}
    assert bytes(gridfs.read_range(chunks, "a", 3, 4, 4).first()[0]) == b"3456"


def test_gridfs_chunks_take_every_page(spark, tmp_path):
    pages = [(1, "plain " * 400), (2, "é日本🙂" * 500), (3, ""), (4, "a" * 1023 + "é"), (5, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = [(k, n, html.encode()[n * 1024 : (n + 1) * 1024].hex().upper()) for k, html in pages for n in range(-(-len((html or "").encode()) // 1024))]
    assert values(__spark_entry__.queries()["gridfs_chunks"](spark, str(tmp_path)), "files_id", "n", "data") == want and len(want) == 11


def test_text(spark):
    df = spark.createDataFrame([("1", "java java java"), ("2", "java code quick"), ("3", "other")], "id string, content string")
    got = text.search(df, "id", "content", "java").collect()
    assert [r["id"] for r in got] == ["1", "2"] and got[0]["score"] == pytest.approx(3 * got[1]["score"])
    words = ["caresses", "ponies", "agreed", "hopping", "falling", "happy", "relational", "bus", "running", "national", "adjustment"]
    assert [text.porter(w) for w in words] == ["caress", "poni", "agre", "hop", "fall", "happi", "relat", "bus", "run", "nation", "adjust"]
    stems = spark.createDataFrame([(w,) for w in ("running", "organization", "cats", "as", "s")], "w string").select(text.suffix_stem(F.col("w"))).collect()
    assert [r[0] for r in stems] == ["runn", "organize", "cat", "a", "s"]
    assert df.select(text.snippet(F.col("content"), "quick")).collect()[1][0] == "java code quick"
    assert text.prefix_tfidf(df, "id", ["content"], "java").first()["id"] == "1"


def test_geo(spark):
    df = spark.createDataFrame([(1, [16, 48]), (2, [0, 0]), (3, None)], "_id int, p array<int>")
    got = geo.near_sorted(df, "p", 16.0, 48.0).collect()
    assert [r["_id"] for r in got] == [1, 2] and got[0]["distance"] == 0.0 and got[1]["distance"] == pytest.approx(5_533_000, rel=0.01)


def test_near_sorted_breaks_ties_by_key(spark, tmp_path):
    # Keys 612,000 apart have the same point: 20 places, each of them twice, the greater keys first.
    keys = [k + 612_000 for k in range(30)] + list(range(30))
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    got = [r["c_custkey"] for r in __spark_entry__.queries()["geo_near_sorted"](spark, str(tmp_path)).collect()]
    assert len(got) == 20 and [k + 612_000 for k in got[::2]] == got[1::2] and all(k < 30 for k in got[::2])
    df = spark.createDataFrame([(k, [1.0, 2.0]) for k in (3, 1, None, 2)], "_id int, p array<double>").coalesce(1)
    assert [r["_id"] for r in geo.near_sorted(df, "p", 0.0, 0.0).collect()] == [1, 2, 3, None]


def test_variant(spark):
    rows = ["{}", '{"x":null}', '{"x":3}', '{"x":2.5}', '{"x":"a"}', '{"x":{"k":1}}', '{"x":[1]}', '{"x":{"$oid":"00"}}', '{"x":true}', '{"x":{"$date":"2020"}}']
    df = variant.parse(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "_id int, j string"), "j")
    x = variant.get(F.col("doc"), "x")
    assert [r[0] for r in df.orderBy(variant.sort_key(x)).select("_id").collect()] == [0, 1, 3, 2, 4, 5, 6, 7, 8, 9]
    assert values(df.filter(variant.compare(F.col("doc"), "x", "$gt", 2.6)), "_id") == [(2,), (4,), (5,), (6,), (7,), (8,), (9,)]
    assert values(df.filter(variant.compare(F.col("doc"), "x", "$eq", None)), "_id") == [(0,), (1,)]
    assert values(df.filter(variant.compare(F.col("doc"), "x", "$eq", 3.0)), "_id") == [(2,)]


def test_places_rise_within_a_second(spark, tmp_path, monkeypatch):
    import vellum.engine as engine

    monkeypatch.setattr(engine.time, "time", lambda: 1_700_000_000.5)
    c = Engine(spark, str(tmp_path)).database("shop").collection("people")
    c.insert([("1", "a"), ("2", "b")], "_id string, name string")
    c.delete({"_id": "1"})
    c.insert([("1", "c")], "_id string, name string")
    c.update_one({"_id": "2"}, {"$set": {"name": "x"}})
    c.update_one({"_id": "2"}, {"$set": {"name": "y"}})
    log = c.database.oplog()
    assert log.select("ts", "c").distinct().count() == log.count() == 6 and {r["ts"] for r in log.collect()} == {1_700_000_000}
    base = spark.createDataFrame([], "_id string, name string")
    assert values(oplog.apply(base, log, c.ns)) == [("1", "c"), ("2", "y")] == values(c.rows())
    w = c.watch(batch=2)
    assert [e["operationType"] for e in w] == ["insert", "insert", "delete", "insert", "update", "update"]
    assert values(backup.restore(base, [log, log], c.ns)) == [("1", "c"), ("2", "y")]


def test_batches_with_repeated_keys(spark, tmp_path):
    c = Engine(spark, str(tmp_path)).database("shop").collection("people")
    c.insert([("1", "old")], "_id string, name string")
    c.insert(spark.createDataFrame([("1", "x"), ("1", "y"), ("2", "z"), ("2", "w")], "_id string, name string").coalesce(1))
    assert values(c.rows()) == [("1", "y"), ("2", "w")]
    assert values(c.database.oplog().filter("op = 'i'").select("id").distinct(), "id") == [("1",), ("2",)] and c.database.oplog().count() == 3


def test_two_writers(spark, tmp_path):
    a = Engine(spark, str(tmp_path)).database("shop").collection("people")
    a.insert([("1", 1)], "_id string, n int")
    stale = a._meta()
    a.update_one({"_id": "1"}, {"$inc": {"n": 1}})
    with pytest.raises(ConflictError):
        a._commit(stale, a.rows(), None)
    assert values(a.rows()) == [("1", 2)]
    # A lost writer's entries are there, once.
    staged = a.database.oplog().count()
    meta = a._meta()
    a.database.oplog().limit(1).write.parquet(f"{a.path}/_log-{meta['version']}")
    assert a.database.oplog().count() == staged + 1 == a.database.oplog().count()
    tries = []

    def add(t):
        if not tries:
            a.update_one({"_id": "1"}, {"$inc": {"n": 10}})
        tries.append(1)
        t.insert([("2", t.find_one({"_id": "1"})["n"])], "_id string, n int")
        t.update({"_id": "2"}, {"$inc": {"n": 1}})
        t.delete({"_id": "9"})
        return t.find({"n": {"$gt": 12}}).count()

    assert a.with_transaction(add) == 1 and len(tries) == 2 and values(a.rows()) == [("1", 12), ("2", 13)]

    def nothing(t):
        t.delete({})
        t.abort()

    a.with_transaction(nothing)
    assert a.count() == 2


def test_admin(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    c = e.database("shop").create("people", capped={"max_docs": 3})
    with pytest.raises(SpecError):
        e.database("shop").create("people")
    c.insert([(k, "n%d" % k) for k in range(5)], "_id int, name string")
    c.modify(max_docs=2)
    c.insert([(9, "x")], "_id int, name string")
    assert values(c.rows(), "_id") == [(4,), (9,)]
    assert e.server_status()["collections"] == 1 and e.current_op() == []
    assert e.run_as("op", c.count) == 2
    e.kill_op("op")
    c.create_index({"name": 1})
    told = c.explain({"name": "x"}, sort={"name": 1})
    assert told["queryPlanner"]["parsedQuery"] == {"name": {"$eq": "x"}} and told["queryPlanner"]["winningPlan"]["stage"] == "COLLSCAN"
    assert told["executionStats"]["nReturned"] == 1 and told["executionStats"]["totalDocsExamined"] == 2
    c.arrange("name_1")
    told = c.explain({"name": "x"}, sort={"name": 1})
    assert told["queryPlanner"]["winningPlan"] == {"stage": "IXSCAN", "direction": "forward", "indexName": "name_1", "sortPattern": {"name": 1}}
    assert told["executionStats"]["totalKeysExamined"] == 1 and values(c.rows(), "_id") == [(4,), (9,)]
    ts = c.database.oplog().agg(F.max("ts")).first()[0]
    n = c.database.oplog().count()
    c.database.truncate_oplog(ts + 1)
    assert c.database.oplog().count() == 0 < n
    assert e.database("none").collection("c").explain()["queryPlanner"]["winningPlan"]["stage"] == "EOF"


def test_update_events(spark, people):
    deltas = [(1, 0, "u", "s.c", "1", '{"$set":{"a":1},"$unset":{"q":""},"z":[2]}', '{"_id":"1"}', 0), (1, 1, "u", "s.c", "1", '{"name":"new","age":3}', '{"_id":"1"}', 0)]
    log = spark.createDataFrame(deltas, oplog.SCHEMA)
    got = [r["updateDescription"] for r in changes.events(log, deltas=True).orderBy(F.unbase64("_id").cast("string")).collect()]
    assert [(d["updatedFields"], d["removedFields"]) for d in got] == [('{"a":1,"z":[2]}', ["q"]), ('{"name":"new","age":3}', [])]
    plain = [r["fullDocument"] for r in changes.events(log).orderBy(F.unbase64("_id").cast("string")).collect()]
    assert plain == [None, '{"name":"new","age":3}']
    people.update_many({}, {"$inc": {"age": 1}})
    people.delete({"_id": "2"})

    def updates_of(mode):
        return [e["fullDocument"] for e in people.watch(fullDocument=mode) if e["operationType"] == "update"]

    assert [x is None for x in updates_of("default")] == [False, False] and updates_of("off") == [None, None]
    assert [x is None for x in updates_of("updateLookup")] == [x is None for x in updates_of("whenAvailable")] == [False, True]
    with pytest.raises(Exception):
        updates_of("required")
    with pytest.raises(SpecError):
        changes.events(log, mode="required")
    w = people.watch()
    assert w.next()["operationType"] == "insert"
    with pytest.raises(TimeoutError):
        for _ in range(9):
            w.next(wait=0.01, timeout=0.01)


def test_bson_splits_and_damage(spark, tmp_path):
    rows = [(k, "x" * (k % 40), [k, 2], (k * 1.5, None)) for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, s string, a array<int>, o struct<d:double,z:string>")
    path = str(tmp_path / "out")
    backup.write(df.coalesce(1), path)
    backup.write(df.coalesce(1), path)
    read = spark.read.format("vellum-bson").schema(df.schema)
    cut = read.option("splitBytes", 7001).load(path)
    assert cut.rdd.getNumPartitions() > 10 and values(cut, "k", "s", "a") == values(df, "k", "s", "a") and cut.agg(F.sum("o.d")).first()[0] == sum(r[0] * 1.5 for r in rows)
    docs = [bytearray(bson.encode({"k": k, "s": "t" * 9})) for k in range(40)]
    docs[1][4] = 0x55  # an unknown type
    docs[7][0:4] = b"\xff\xff\xff\x7f"  # a length that can't be
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.bson").write_bytes(b"".join(docs))
    for split in (0, 200):
        got = spark.read.format("vellum-bson").schema("k int").option("mode", "PERMISSIVE").option("splitBytes", split).load(str(tmp_path / "bad"))
        assert values(got, "k") == [(k,) for k in range(40) if k not in (1, 7)]
    assert values(backup.read(spark, str(tmp_path / "bad"), got.schema, lenient=True), "k") == values(got, "k")
    with pytest.raises(Exception):
        backup.read(spark, str(tmp_path / "bad"), got.schema).collect()


def test_restore_with_repeated_increments(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "_id int, s string")
    log = spark.createDataFrame([(5, 1, "u", "d.a", "1", '{"_id":1,"s":"x"}', None, 0), (5, 2, "d", "d.a", "2", "{}", None, 0), (5, 3, "u", "d.a", "1", '{"_id":1,"s":"y"}', None, 0), (6, 1, "i", "d.a", "9", '{"_id":9,"s":"n"}', None, 0), (6, 2, "i", "d.b", "3", '{"_id":3,"s":"other"}', None, 0)], oplog.SCHEMA)
    got = backup.restore(base, [log, log, backup.increment(log, 5), log], "d.a")
    assert values(got, "_id", "s") == [(1, "y"), (3, "c"), (9, "n")]
    # A backup's entries are read by columns, whatever is null in them.
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = [bson.encode({n: v for n, v in zip(oplog.SCHEMA.names, r) if v is not None}) for r in log.collect()]
    good, columns = bson._fast_arrays(docs, oplog.SCHEMA, to_arrow_schema(oplog.SCHEMA))
    assert good.all() and list(zip(*(c.to_pylist() for c in columns))) == [tuple(r) for r in log.collect()]


PLAIN = "k long, b byte, d double, f float, s string, x binary, t timestamp, z timestamp_ntz, ok boolean"


def _plain_rows():
    when = dt.datetime(1969, 12, 31, 23, 59, 59, 999_999, dt.timezone.utc)
    keys = [*range(50), 2**31 - 1, 2**31, -(2**31), -(2**31) - 1, 2**62]
    rows = [(k, i, k / 7, i / 2, "é\0🙂" * (i % 5), bytes([i]) * (i % 3), when + dt.timedelta(hours=i), dt.datetime(2020, 1, 1, 0, 0, 0, i), i % 2 == 0) for i, k in enumerate(keys)]
    return rows + [tuple(None if i % (j + 2) == 0 else v for j, v in enumerate(rows[i])) for i in range(40)] + [(None,) * 9]


def _batches(rows, schema, size):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], to_arrow_schema(schema)).to_batches(size)


def test_bson_by_columns(spark, tmp_path, monkeypatch):
    rows, schema = [tuple(r) for r in _plain_rows()], spark.createDataFrame([], PLAIN).schema
    want = [bson.encode({n: v for n, v in zip(schema.names, r) if v is not None}) for r in rows]
    docs = [bson.decode(d) for d in want]
    path = tmp_path / "plain.bson"
    path.write_bytes(b"".join(want))
    # Plain columns are made of many documents at once: not one goes through the codec for single ones.
    for name in ("encode", "decode"):
        monkeypatch.setattr(bson, name, lambda _: pytest.fail("one by one"))
    writer = bson.BsonSource({"path": str(tmp_path)}).writer(schema, True)
    for size in (1, 7, 1000):
        assert b"".join(map(bytes, writer._encoded(_batches(rows, schema, size)))) == b"".join(want)
    monkeypatch.setattr(bson, "BATCH_BYTES", 300)
    assert b"".join(map(bytes, writer._encoded(_batches(rows, schema, 1000)))) == b"".join(want)
    for most in (1, 300, 1 << 20):
        monkeypatch.setattr(bson, "BATCH_BYTES", most)
        got = [r for b in bson.BsonReader(schema, {"path": str(path)}).read(bson._Part(str(path), 0, None)) for r in b.to_pylist()]
        assert got == [{n: bson._fit(d.get(n), schema[n].dataType) for n in schema.names} for d in docs]


def test_bson_odd_documents_among_plain_ones(spark, tmp_path):
    plain = [{"k": i, "s": "x" * i} for i in range(5)]
    odd = [{"s": "order", "k": 7}, {"k": 8, "more": [1], "s": "y"}, {"k": 9.0, "s": 1}, {"k": 2**40}, {"k": None, "s": None}, {"k": "no", "s": {"a": 1}}, {"k": 1, "s": bson.ObjectId(bytes(12))}, {}]
    want = [(i, "x" * i) for i in range(5)] + [(7, "order"), (8, "y"), (9, "1"), (2**40, None), (None, None), (None, '{"a": 1}'), (1, "00" * 12), (None, None)]
    raws = [bson.encode(d) for d in plain + odd]
    twice = bson.encode({"k": 1, "z": 5, "s": "t"}).replace(b"\x10z\0", b"\x10k\0")  # the last of a repeated field counts
    text = bytearray(bson.encode({"k": 3, "s": "ab"}))
    text[-3] = 0xFF  # no UTF-8
    short = bytearray(bson.encode({"k": 4, "s": "ab"}))
    short[-8:-4] = b"\x10\0\0\0"  # a text longer than its document
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "a.bson").write_bytes(b"".join([*raws, twice, *raws]))
    schema = spark.createDataFrame([], "k long, s string").schema
    read = lambda name, lenient=False: [tuple(r) for r in backup.read(spark, str(tmp_path / name), schema, lenient=lenient).collect()]
    assert read("a") == want + [(5, "t")] + want
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.bson").write_bytes(b"".join([raws[1], bytes(text), raws[0], raws[2]]))
    assert read("b", True) == [want[1], want[0], want[2]]
    with pytest.raises(Exception):
        read("b")
    assert bson._fast_arrays([bytes(short), raws[0]], schema, __import__("pyspark.sql.pandas.types", fromlist=["x"]).to_arrow_schema(schema))[0].tolist() == [False, True]


def test_bucket(spark, tmp_path):
    b = gridfs.Bucket(Engine(spark, str(tmp_path)).database("shop"), chunk_size=5)
    data = bytes(range(23))
    id = b.upload("a.bin", data, contentType="x/y", metadata={"k": "v"}, aliases=["z"])
    found = b.find_one({"filename": "a.bin"})
    assert (found["_id"], found["length"], found["contentType"], found["metadata"], found["aliases"]) == (id, 23, "x/y", {"k": "v"}, ["z"])
    s = b.open_download(id)
    assert s.read(3) == data[:3] and s.read(9) == data[3:12] and s.seek(-2, 2) == 21 and s.read() == data[21:] and s.read() == b""
    assert s.seek(4) == 4 and s.read(1) == data[4:5] and s.tell() == 5
    with pytest.raises(ValueError):
        s.seek(24)
    b.rename(id, "b.bin")
    later = b.upload("b.bin", b"")
    assert b.open_download_by_name("b.bin").file["_id"] == later and b.open_download(later).read() == b""
    import io

    out = io.BytesIO()
    assert b.download(id, out) == 23 and out.getvalue() == data
    with pytest.raises(KeyError):
        with b.open_upload("c.bin") as up:
            up.write(b"abc")
            raise KeyError
    b.add(spark.createDataFrame([(7, b"0123456789ab"), (8, b"")], "id int, raw binary"), "id", "raw")
    assert b.open_download("7").read() == b"0123456789ab" and b.open_download("8").read() == b""
    b.delete(id)
    b.delete_by_name("b.bin")
    assert values(b.find(), "filename") == [("7",), ("8",)] and values(b.chunks.rows(), "files_id") == [("7",)] * 3
    with pytest.raises(FileNotFoundError):
        b.open_download(id)
    b.drop()
    assert b.files.count() == 0


def test_shell(spark, tmp_path):
    from vellum.sources import shell

    assert shell.parse("") == {} and shell.parse("{}") == {}
    got = shell.parse("""{name: 'Ann "x"', "a b": [1, -2.5, 3e2, null, true,], n: {$gt: 9999999999} on: $set, r: /^a\\/b/i, d: {"$date": "2020-01-02T03:04:05Z"},
        id: ObjectId("0123456789ABCDEF01234567"), l: NumberLong("7"), o: {"$numberLong": "8"}, w: new Date("2020-01-01"), u: "\\u00e9\\n"}""")
    assert got == {
        "name": 'Ann "x"', "a b": [1, -2.5, 300.0, None, True], "n": {"$gt": 9999999999}, "on": "$set", "r": {"$regex": "^a\\/b", "$options": "i"}, "d": dt.datetime(2020, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc),
        "id": "0123456789abcdef01234567", "l": 7, "o": 8, "w": dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc), "u": "é\n",
    }
    for bad in ("{a}", "{a: }", "{a: 1", "[1]", "{a: foo}", "{a: 1} x", "{a: ObjectId('1')}", "{a: 'x}"):
        with pytest.raises(SpecError):
            shell.parse(bad)
    s = shell.Shell(Engine(spark, str(tmp_path)))
    assert s.run("use shop") == "shop" and s.run("show collections") == []
    assert s.run("db.people.insert([{_id: 'a', age: 30}, {_id: 'b', age: 40}]);") == 2
    s.run("db.people.update({_id: 'a'}, {$inc: {age: 1}})")
    s.run("db.people.insert({_id: 'c', age: 5})")
    s.run("db.people.delete({age: {$lt: 10}})")
    assert values(s.run("db.people.find({age: {$gte: 31}})"), "_id", "age") == [("a", 31), ("b", 40)] and s.run("db.people.count()") == 2
    assert s.run("db.people.findOne({_id: 'b'})")["age"] == 40 and s.run("show dbs") == ["shop"]
    assert s.run("db.people.aggregate([{$group: {_id: null, n: {$sum: 1}}}])").first()["n"] == 2
    s.run("db.people.drop()")
    assert s.run("show collections") == []
    with pytest.raises(SpecError):
        s.run("db.people.explode()")
