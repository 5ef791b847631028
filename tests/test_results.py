"""Limits, errors and second tries of conversions, similarity, reports and plain text."""

import json
import time

import pytest
from pyspark.sql import functions as F

from foliant.operators import manifest, publish
from foliant.sources import files


def sleeper(data, name, options):
    for _ in range(500):
        time.sleep(0.01)
    return "late", {}


def test_timeout():
    readers = {"text": ("slow", sleeper), "code": ("fast", lambda d, n, o: ("now", {}))}
    began = time.time()
    got = files.convert_one("a.txt", "text", b"x", {}, readers, 0.1)
    assert not got["success"] and got["error"] == "TimeoutError: not converted within 0.1 s" and time.time() - began < 3
    assert files.convert_one("a.py", "code", b"x", {}, readers, 0.1)["success"]
    time.sleep(0.15)  # no timer is left


@pytest.fixture
def results(spark):
    rows = [("a.txt", "text", b"one"), ("b.zzz", "unknown", b"two"), ("c.json", "json", b"[1]")]
    return spark.createDataFrame(rows, "path string, kind string, content binary")


def test_errors_and_tries(spark, results):
    made = files.converted(results)
    assert {r.source: (r.success, r.c) for r in made.withColumn("c", files.error_class(F.col("error"))).collect()} == {"a.txt": (True, None), "b.zzz": (False, "unavailable"), "c.json": (True, None)}
    with pytest.raises(Exception, match="b.zzz"):
        files.strictly(made).select("success").collect()
    assert files.strictly(made.filter("source <> 'b.zzz'")).filter("success").count() == 2
    again = files.redone(made, results, readers={"unknown": ("late", lambda d, n, o: (d.decode(), {}))})
    assert {r.source: (r.success, r.engine) for r in again.collect()} == {"a.txt": (True, "text"), "b.zzz": (True, "late"), "c.json": (True, "text")}
    said = spark.createDataFrame([("TimeoutError: x",), ("ValueError: the file is encrypted",), ("ValueError: x",), (None,)], "e string")
    assert [r.c for r in said.select(files.error_class(F.col("e")).alias("c")).collect()] == ["timeout", "protected", "failed", None]


def test_similarity(spark):
    pairs = spark.createDataFrame([("a\nb\nc", "a\nx\nc"), ("", ""), ("a", "b"), (None, "a"), ("a\nb", "a")], "a string, b string")
    assert [r.s for r in pairs.select(manifest.similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [pytest.approx(2 / 3), 1.0, 0.0, None, pytest.approx(2 / 3)]


def test_report_of_one_file(results, tmp_path):
    made = files.converted(results).withColumns({"duration_s": F.lit(0.0), "output": F.lit(None).cast("string")})
    publish.write_report(made, str(tmp_path / "r.json"))
    rows = json.loads((tmp_path / "r.json").read_text())
    assert [(r["source"], r["status"], r["output"]) for r in rows] == [("a.txt", "Success", None), ("b.zzz", "Error", None), ("c.json", "Success", None)]
    publish.write_report(made.filter("false"), str(tmp_path / "e.json"))
    assert json.loads((tmp_path / "e.json").read_text()) == []


@pytest.mark.parametrize("markdown, wanted", [
    ("# Head\n\nsome **bold** and *it* `code`\n", "Head\n\nsome bold and it code\n"), ("- a\n  - b\n> q\n", "a\nb\nq\n"), ("see [here](http://x) ![pic](y)", "see here pic"),
    ("| a | b |\n| --- | --- |\n| 1 \\| 2 | 3 |\n", "a\tb\n1 | 2\t3\n"), ("```py\nx = 2 * 3 * 4\n```\n", "x = 2 * 3 * 4\n"), ("2 * 3 * 4", "2 * 3 * 4"), ("", ""), (None, None),
])
def test_as_text(spark, markdown, wanted):
    assert spark.createDataFrame([(markdown,)], "m string").select(publish.as_text(F.col("m")).alias("t")).first().t == wanted
