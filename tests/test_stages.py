import json
import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators import catalog
from quillspark.sources import results, store
from quillspark.sources.snapshots import SnapshotConflict, Snapshots

RESULT = T.StructType().add("file_path", "string").add("pages", T.ArrayType(T.StructType().add("page_number", "integer").add("content", "string"))).add("n", "long")


def some_results(spark, n):
    pages = F.transform(F.sequence(F.lit(1), (F.col("id") % 3 + 1).cast("int")), lambda i: F.struct(i.alias("page_number"), F.concat(F.lit('é "x"\n'), i.cast("string")).alias("content")))
    return spark.range(n).select(F.concat(F.lit("/a.b/dir"), F.col("id") % 7, F.lit("/report."), "id", F.lit(".pdf")).alias("file_path"), pages.alias("pages"), F.col("id").alias("n"))


def test_round_trip_of_many(spark, tmp_path):
    rows = some_results(spark, 10_000).cache()
    results.write_results(rows, str(tmp_path))
    found, bad = results.read_results(spark, str(tmp_path), RESULT)
    assert bad.count() == 0 and found.count() == 10_000
    assert found.exceptAll(rows).count() == rows.exceptAll(found).count() == 0
    names = {p.name for p in tmp_path.glob("run=*/part-*/*.json")}
    assert len(names) == 10_000 and names == {results.result_name(r.file_path) for r in rows.select("file_path").collect()}
    assert {r.n for r in rows.select(results.result_name_of(F.col("file_path")).alias("n")).collect()} == names


def test_names():
    assert results.result_name("/a/b.c/x.y.txt").startswith("x.y_") and results.result_name("plain").startswith("plain_") and len(results.result_name("/x.pdf")) == len("x_.json") + 12


def test_later_runs_and_replacement(spark, tmp_path):
    rows = some_results(spark, 20)
    results.write_results(rows, str(tmp_path))
    results.write_results(rows.filter("n < 5").withColumn("n", F.col("n") + 100), str(tmp_path))
    read = lambda: sorted(r.n for r in results.read_results(spark, str(tmp_path), RESULT)[0].collect())
    assert read() == [*range(5, 20), *range(100, 105)]
    results.write_results(rows.filter("n < 2"), str(tmp_path), replace=True)
    assert read() == [0, 1]
    assert results.read_results(spark, str(tmp_path / "none"), RESULT)[0].count() == 0


def test_failed_write_leaves_nothing(spark, tmp_path):
    results.write_results(some_results(spark, 5), str(tmp_path))
    broken = some_results(spark, 50).repartition(5).withColumn("n", F.when(F.col("n") == 33, F.raise_error(F.lit("task killed")).cast("long")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="task killed"):
        results.write_results(broken, str(tmp_path))
    assert results.read_results(spark, str(tmp_path), RESULT)[0].count() == 5
    (tmp_path / "run=9" / "part-0-0").mkdir(parents=True)  # of a driver that died before its commit
    (tmp_path / "run=9" / "part-0-0" / "half_123.json").write_text('{"file_path": "/ha')
    assert results.read_results(spark, str(tmp_path), RESULT)[0].count() == 5
    assert "run=9" in results.remove_unfinished(str(tmp_path), 0) and len(list(tmp_path.glob("run=*"))) == 1
    assert results.read_results(spark, str(tmp_path), RESULT)[0].count() == 5


def test_malformed_files_say_why(spark, tmp_path):
    texts = [("/1", '{"file_path": "/1", "n": 1, "other": [1]}'), ("/2", '{"file_path": "/2", "n":'), ("/3", "[1]"), ("/4", '{"n": 1}'), ("/5", '{"file_path": "/5", "n": "x"}'), ("/6", ""), ("/7", "7"), ("/8", '{"file_path": " "}')]
    results.write_texts(spark.createDataFrame(texts, "file_path string, result string"), str(tmp_path))
    found, bad = results.read_results(spark, str(tmp_path), RESULT)
    assert [tuple(r) for r in found.collect()] == [("/1", None, 1)]
    reasons = {r.file_name: r.reason for r in bad.collect()}
    assert reasons == {results.result_name(p): w for p, w in {"/2": "no JSON", "/3": "no object", "/4": "no file_path", "/5": "fields of other types", "/6": "no JSON", "/7": "no object", "/8": "no file_path"}.items()}


def test_files_are_read_in_few_tasks_and_whatever_their_name(spark, tmp_path):
    rows = some_results(spark, 600).unionByName(some_results(spark, 2).withColumn("file_path", F.concat(F.lit("/dir/"), F.when(F.col("n") == 0, "_hidden.txt").otherwise(".dot"))))
    results.write_results(rows, str(tmp_path))
    files = results.read_files(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() == 4  # not one for every 32 files
    assert {r.file_name for r in files.select("file_name").collect()} == {results.result_name(r.file_path) for r in rows.collect()}
    found, bad = results.read_results(spark, str(tmp_path), RESULT)
    assert bad.count() == 0 and found.exceptAll(rows).count() == rows.exceptAll(found).count() == 0


def test_results_move_once(spark, tmp_path):
    rows = some_results(spark, 30).unionByName(some_results(spark, 5).withColumn("n", F.col("n") + 50).repartition(3))  # five paths come twice in one run
    results.write_results(rows.repartition(4, "n"), str(tmp_path))
    results.write_results(rows.filter("n = 7").withColumn("n", F.lit(99).cast("long")), str(tmp_path))
    found, _ = results.read_results(spark, str(tmp_path), RESULT)
    assert "max_by" not in found._jdf.queryExecution().optimizedPlan().toString()  # the file's text alone goes through the shuffle, not what is read from it as well
    assert sorted(r.n for r in found.filter("file_path not rlike 'report[.][0-4][.]pdf'").collect()) == [5, 6, *range(8, 30), 99]
    assert found.count() == 30


def test_bytes_of_files_are_kept(spark, tmp_path):
    results.write_texts(spark.createDataFrame([("/a.txt", "x")], "file_path string, result string"), str(tmp_path))
    next(tmp_path.glob("run=*/part-*/*.json")).write_bytes(b"\xef\xbb\xbf\r\n\xff\x00")
    assert [bytes(r[0]) for r in results.read_files(spark, str(tmp_path)).select(F.col("text").cast("binary")).collect()] == [b"\xef\xbb\xbf\r\n\xff\x00"]


def test_discovery(spark):
    record = {f.name: "x" for f in results.RECORD} | {"file_size": 5, "date_last_modified": 1.5, "filetype": "pdf"}
    text = {"new": [record | {"supported": True}, record | {"more": 1}, 7, None, {k: v for k, v in record.items() if k != "filename"}, record | {"filetype": "exe"}], "modified": "none", "deleted": [record]}
    rows = spark.createDataFrame([(json.dumps(text),), ("{",), (None,), ("[]",), ('{"new": []}',)], "text string")
    files, rejected = results.discovered(rows, ["pdf"])
    assert [(r.category, r.file_size, r.date_last_modified) for r in files.collect()] == [("new", 5, 1.5)]
    assert sorted((r.category, r["at"], r.reason) for r in rejected.collect() if r["at"] is not None) == [("new", 1, "fields"), ("new", 2, "no object"), ("new", 3, "no object"), ("new", 4, "fields")]
    assert [(r.category, r.reason) for r in rejected.filter("at is null").collect()] == [("modified", "no list")]


def test_two_publishers_one_winner(spark, tmp_path):
    store_ = Snapshots(spark, str(tmp_path))
    base = store_.publish({"a": spark.range(3), "b": spark.range(2)})
    ready, said = threading.Barrier(2), []

    def publish(n):
        def slow(df):
            ready.wait()
            return df

        try:
            said.append(("ok", Snapshots(spark, str(tmp_path)).publish({"a": slow(spark.range(n))}, base=base)))
        except SnapshotConflict as e:
            said.append(("conflict", str(e)))

    threads = [threading.Thread(target=publish, args=(n,)) for n in (10, 20)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(k for k, _ in said) == ["conflict", "ok"]
    assert "version 2 has changed a since version 1" in dict(said)["conflict"]
    assert store_.latest() == 2 and store_.read("a").count() in (10, 20) and store_.read("b").count() == 2
    assert len(list((tmp_path / "data").iterdir())) == 3  # the loser's data are gone


def test_publishers_of_other_tables_both_win(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    base = s.publish({"a": spark.range(1), "b": spark.range(1)})
    s.publish({"a": spark.range(5)}, base=base)
    assert s.publish({"b": spark.range(6)}, base=base) == 3
    assert {n: t.rows for n, t in s.manifest().items()} == {"a": 5, "b": 6}
    with pytest.raises(SnapshotConflict):
        s.publish({"c": spark.range(1)}, base=base, replace=True)


def test_readers_see_whole_versions(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    s.publish({"a": spark.range(4), "b": spark.range(4)})
    pinned = s.read("a")
    bad = spark.range(9).withColumn("id", F.when(F.col("id") == 7, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        s.publish({"a": spark.range(100), "b": bad})
    assert s.latest() == 1 and s.read("a").count() == pinned.count() == 4
    s.vacuum(older_than_s=0.0)
    assert len(list((tmp_path / "data").iterdir())) == 2
    s.publish({"a": spark.range(7)})
    assert pinned.count() == 4 and s.read("a").count() == 7 and s.read("a", 1).count() == 4
    assert sorted((r.table_name, r.row_count) for r in s.counts().collect()) == [("a", 7), ("b", 4)]


def test_vacuum_and_ensure(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    wanted = {"a": T.StructType().add("id", "long"), "c": T.StructType().add("x", "string")}
    assert s.missing(wanted) == ["a", "c"] and s.latest() is None and s.manifest() == {} and s.counts().count() == 0
    for n in range(4):
        s.publish({"a": spark.range(n)})
    assert s.missing(wanted) == ["c"] and s.ensure(wanted) == 5 and s.missing(wanted) == [] and s.ensure(wanted) == 5
    assert s.read("c").count() == 0 and s.read("a").count() == 3
    (tmp_path / "data" / "left-over").mkdir()
    assert s.vacuum(keep=2) == []  # all are too young
    time.sleep(0.05)
    gone = s.vacuum(keep=2, older_than_s=0.0)
    assert "left-over" in gone and len(gone) == 4 and s.versions() == [4, 5] and s.read("a").count() == 3


def test_csv_replaced_at_once(spark, tmp_path):
    path = str(tmp_path / "master")
    store.replace_csv(spark.range(3), path)
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("half way")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="half way"):
        store.replace_csv(broken, path)
    assert store.read_csv(spark, path, T.StructType().add("id", "long")).count() == 3
    store.replace_csv(spark.range(8), path)
    assert store.read_csv(spark, path, T.StructType().add("id", "long")).count() == 8
    assert [p.name for p in tmp_path.iterdir()] == ["master"]


def test_hash_of_large_files(spark, tmp_path):
    import hashlib

    small, large = tmp_path / "s" / "a.bin", tmp_path / "s" / "big.bin"
    small.parent.mkdir()
    small.write_bytes(b"abc" * 1000)
    with large.open("wb") as f:
        f.truncate(3 << 30)
    paths = spark.createDataFrame([(str(small), 3000), (str(large), 3 << 30), (str(tmp_path / "gone"), 1)], "file_path string, file_size long")
    found = {r.file_path: r.file_hash for r in catalog.hashed_files(paths).collect()}
    digest = hashlib.sha256()
    for _ in range(3 << 10):
        digest.update(bytes(1 << 20))
    assert found == {str(small): hashlib.sha256(b"abc" * 1000).hexdigest(), str(large): digest.hexdigest(), str(tmp_path / "gone"): None}
