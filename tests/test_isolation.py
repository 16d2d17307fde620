import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import text
from quillspark.operators import isolation, selection
from quillspark.streaming import monitoring

RESULT = T.StructType().add("double", "long")


def doubled(row):
    if row["source"] == "c":
        raise ValueError("bad source")
    return {"double": 2 * row["x"]}


def test_one_bad_source_of_five(spark):
    rows = spark.createDataFrame([(s, i) for s in "abcde" for i in range(20)], "source string, x long").repartition(4)
    good, bad = isolation.isolated(rows, "source", doubled, RESULT)
    assert good.columns == ["source", "double"]
    assert {(r.source, r.n) for r in good.groupBy("source").agg(F.sum("double").alias("n")).collect()} == {(s, 380) for s in "abde"}
    assert [tuple(r) for r in bad.collect()] == [("c", 20, "ValueError: bad source")]


def test_nulls_and_none(spark):
    rows = spark.createDataFrame([(None, 1), ("a", None), ("a", 1)], "source string, x long")
    good, bad = isolation.isolated(rows, "source", doubled, RESULT)
    assert [tuple(r) for r in good.collect()] == [(None, 2)] and [r.source for r in bad.collect()] == ["a"]
    assert [x.count() for x in isolation.isolated(rows.limit(0), "source", doubled, RESULT)] == [0, 0]


def test_queries_that_fail_alone(spark):
    parts = {"good": lambda: spark.range(3), "no column": lambda: spark.range(3).select("nothing"), "at run time": lambda: spark.range(3).select(F.raise_error(F.lit("broken")).cast("long").alias("x"))}
    results, errors = isolation.isolated_parts(parts)
    assert list(results) == ["good"] and results["good"].count() == 3
    assert set(errors) == {"no column", "at run time"} and "nothing" in errors["no column"]


SCHEMA = T.StructType().add("run_uuid", "string").add("stage_name", "string").add("at", "long")


def test_a_restarted_stream_appends_once(spark, tmp_path):
    source, root, checkpoint = tmp_path / "in", str(tmp_path / "log"), tmp_path / "checkpoint"
    source.mkdir()
    stream = lambda: monitoring.append_stages(spark.readStream.schema(SCHEMA).json(str(source)), root, str(checkpoint))
    assert monitoring.stages_of(spark, root, SCHEMA).count() == 0
    for n in range(3):
        (source / f"{n}.json").write_text("\n".join(f'{{"run_uuid": "r{n}", "stage_name": "s{i}", "at": {i}}}' for i in range(5)))
        assert stream().awaitTermination(60) and monitoring.stages_of(spark, root, SCHEMA).count() == 5 * (n + 1)
    last = max((checkpoint / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    os.remove(last)  # as if the driver had died after the batch's data and before its commit
    for crc in (checkpoint / "commits").glob(f".{last.name}*"):
        os.remove(crc)
    assert stream().awaitTermination(60)
    found = monitoring.stages_of(spark, root, SCHEMA)
    assert found.count() == found.select("run_uuid", "stage_name").distinct().count() == 15
    again = spark.createDataFrame([("r", "s", 2, 0), ("r", "s", 1, 1), ("r", "t", 5, 0)], "run_uuid string, stage_name string, at long, batch long")
    assert sorted((r.stage_name, r["at"]) for r in monitoring.first_of_each(again, ["run_uuid", "stage_name"], "at").collect()) == [("s", 1), ("t", 5)]


def test_config_of_sources(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "data_source string, batch_size int")
    assert [tuple(r) for r in selection.config_of(rows, ["b"], ["batch_size"]).collect()] == [("b", 2)]
    assert selection.config_of(rows, [], ["batch_size"]).count() == 0
    with pytest.raises(LookupError, match="no such data source: x, y"):
        selection.config_of(rows, ["y", "a", "x"], ["batch_size"])


def test_head_and_tail(spark):
    row = spark.createDataFrame([("abcdefghij", "abc", None)], "a string, b string, c string").select(*[text.head_and_tail(F.col(c), 5).alias(c) for c in "abc"]).first()
    assert tuple(row) == ("ab\n...\nhij", "abc", None)
