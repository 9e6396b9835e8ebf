from pyspark.sql import functions as F

from pairloom.operators import privacy
from pairloom.sources import store, tables, text_files
from pairloom.sources.keyed import KeyedTable
from pairloom.streaming import applications as sa


def test_csv_keeps_empty_strings(spark, tmp_path):
    schema = "id int, text string, score double"
    df = spark.createDataFrame([(1, "", 0.1234565), (2, 'say "hi"\nnow', 2.5), (3, "a,b", None)], schema)
    tables.write_csv(df, str(tmp_path / "t"))
    back = {r["id"]: r for r in tables.read_csv(spark, str(tmp_path / "t"), schema).collect()}
    assert back[1]["text"] == "" and back[2]["text"] == 'say "hi"\nnow' and back[3]["score"] is None and back[1]["score"] == 0.123456
    assert all(t == "string" for _, t in tables.read_csv_as_text(spark, str(tmp_path / "t")).dtypes)


def test_parts_carry_their_file_name(spark, tmp_path):
    for name in ("train", "test"):
        spark.range(3).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    got = tables.read_parts(spark, str(tmp_path)).groupBy("original_split").count().collect()
    assert {(r[0], r[1]) for r in got} == {("train", 3), ("test", 3)}


def test_text_ingest(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café\r\n\r\n\r\n\r\n  two   words ".encode())
    (tmp_path / "b.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "c.txt").write_bytes(b"  \n ")
    (tmp_path / "d.bin").write_bytes(b"x")
    (tmp_path / "e.doc").write_bytes(b"old\x01 file")
    docs, bad = text_files.read_documents(spark, str(tmp_path))
    assert {r["name"]: r["text"] for r in docs.collect()} == {"a.txt": "café\n\n two words", "b.txt": "café", "e.doc": "old file"}
    assert {r["name"]: r["reason"] for r in bad.collect()} == {"c.txt": "no_text", "d.bin": "unsupported_type"}


def test_json_and_fingerprint(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"k": 3}'), (2, None)], "id int, props string")
    decoded = tables.decode_json(df, {"props": "struct<k:int>"})
    assert decoded.first()["props"]["k"] == 3 and tables.encode_json(decoded, ["props"]).first()["props"] == '{"k":3}'
    tables.write_json(decoded, str(tmp_path / "j"))
    assert tables.read_text_files(spark, str(tmp_path), "*.json").count() >= 1
    assert tables.fingerprint(df).collect() == tables.fingerprint(df.orderBy(F.desc("id"))).collect()


def test_upsert_and_cascade(spark):
    current = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id int, v string, at int")
    changes = spark.createDataFrame([(1, "c", 2), (2, "old", 4), (3, "new", 1)], "id int, v string, at int")
    assert sorted(tuple(r) for r in store.upsert(current, changes, ["id"], F.col("at")).collect()) == [(1, "c", 2), (2, "b", 5), (3, "new", 1)]
    jobs = spark.createDataFrame([(1,), (2,)], "id int")
    matches = spark.createDataFrame([(10, 1), (11, 2)], "id int, job_id int")
    apps = spark.createDataFrame([(20, 1), (21, 2), (22, None)], "id int, job_id int")
    out = store.cascade_delete({"jobs": jobs, "matches": matches, "apps": apps}, jobs.where("id = 1"), "jobs", "id", {"matches": "job_id"}, {"apps": "job_id"})
    assert [r["id"] for r in out["matches"].collect()] == [11]
    assert sorted((r["id"], r["job_id"]) for r in out["apps"].collect()) == [(20, None), (21, 2), (22, None)]


def bucket_files(place):
    return {f: (f.stat().st_mtime_ns, f.stat().st_size) for f in place.rglob("*.parquet")}


def test_keyed_table_rewrites_only_touched_buckets(spark, tmp_path):
    schema = "id long, part string, at int, v string"
    rows = [(i, "a" if i % 2 else None, 1, f"v{i}") for i in range(200)]
    kept = KeyedTable(spark, str(tmp_path / "t"), ["id", "part"], 16)
    assert not kept.exists()
    kept.create(spark.createDataFrame(rows, schema))
    want, before = {r[:2]: r[2:] for r in rows}, bucket_files(tmp_path)
    assert kept.exists() and {(r.id, r.part): (r.at, r.v) for r in kept.read().collect()} == want

    changes = [(4, None, 2, "newer"), (5, "a", 0, "older"), (6, None, 1, "same"), (7, "b", 1, "other part"), (6, None, 0, "older still"), (None, "a", 1, "no id")]
    for _ in range(2):  # a repeated change is harmless
        kept.upsert(spark.createDataFrame(changes, schema), ["at"])
    want |= {(4, None): (2, "newer"), (6, None): (1, "same"), (7, "b"): (1, "other part"), (None, "a"): (1, "no id")}
    got = kept.read().collect()
    assert len(got) == len(want) and {(r.id, r.part): (r.at, r.v) for r in got} == want
    after = bucket_files(tmp_path)
    same = {f for f in before if after.get(f) == before[f]}
    changed = {f.parent.name for f in set(after) - same}
    assert same and len(changed) <= 5 and not changed & {f.parent.name for f in same}

    kept.delete(spark.createDataFrame([(4, None), (9999, "z"), (None, "a")], "id long, part string"))
    del want[4, None], want[None, "a"]
    assert {(r.id, r.part): (r.at, r.v) for r in kept.read().collect()} == want
    kept.delete(kept.read())
    assert kept.read().count() == 0
    kept.upsert(spark.createDataFrame(rows[:3], schema), ["at"]).upsert(spark.createDataFrame([], schema), ["at"])
    assert kept.read().count() == 3
    assert KeyedTable(spark, str(tmp_path / "e"), ["id"], 4).create(spark.createDataFrame([], schema)).read().count() == 0


def test_privacy_scan(spark):
    df = spark.createDataFrame([(1, "write to a.b@example.com"), (2, "call (555) 123-4567 or www.x.org"), (3, "nothing 2024")], "id int, text string")
    got = {(r["id"], r["finding"]) for r in privacy.scan_texts(df, "id", "text").collect()}
    assert got == {(1, "e-mail address"), (2, "phone-number pattern"), (2, "URL")}
    wide = spark.createDataFrame([("x" * 130, "y")], "note string, email string")
    assert {r["finding"] for r in privacy.scan_columns(wide, "t").collect()} == {"forbidden column 'email'", "text cell of 130 characters"}


def test_late_rows_are_dropped_and_state_is_order_free(spark, tmp_path):
    schema = "event_id long, ts timestamp, application_id long, stage string, event_type string, value double"
    def put(name, rows):
        df = spark.createDataFrame([(i, t, a, s, "x", 1.0) for i, t, a, s in rows], "event_id long, ts string, application_id long, stage string, event_type string, value double")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put("1", [(1, "2024-01-01 10:00:00", 1, "saved"), (2, "2024-01-03 10:00:00", 1, "applied")])
    state = lambda: sa.write_state(sa.application_state_stream(sa.read_events(spark, str(tmp_path / "in"), schema)), str(tmp_path / "state"), str(tmp_path / "cp1")).awaitTermination()
    def days():
        stream = sa.activity_counts_stream(sa.read_events(spark, str(tmp_path / "in"), schema))
        stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "days")).option(
            "checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    state(), days()
    put("2", [(3, "2024-01-01 11:00:00", 1, "late"), (4, "2024-01-02 10:00:00", 2, "offer")])
    state(), days()
    got = {r["application_id"]: (r["status"], r["n_changes"]) for r in sa.read_state(spark, str(tmp_path / "state"), ["application_id"]).collect()}
    assert got == {1: ("applied", 3), 2: ("offer", 1)}
    stored = spark.read.parquet(str(tmp_path / "state" / "32_buckets")).where("_entry")
    assert stored.count() == 2  # one row per application, whatever the number of batches
    counted = spark.read.parquet(str(tmp_path / "days")).collect()
    assert [(r["day"].day, r["n"]) for r in counted] == [(1, 1)]


def test_streams_read_a_folder_of_many_files(spark, tmp_path):
    from pairloom.catalog import applications as cat
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, cat.application_state_stream(spark, str(tmp_path)).collect()), key=str)
    assert got and got == sorted(map(tuple, cat.application_state_stream(spark, "/root/testdata/sf0.001").collect()), key=str)
