"""Readers, writers, streams and calibration on small inputs."""

import gzip
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import calibrate
from millrace.sources import files
from millrace.streaming import logs


def test_json_lines(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt", encoding="utf-8") as f:
        f.write('{"_meta": 1}\n{"ex": 1, "s": "a b"}\n{"ex": 2, "s": null}\n{"ex": 3, "s": "ha')
    rows = files.read_predictions(spark, str(tmp_path / "a.jsonl.gz"), "ex long, s string")
    assert [tuple(r) for r in rows.collect()] == [(1, "a b"), (2, None)]
    files.write_jsonl(rows.withColumn("split", F.lit("test")), str(tmp_path / "out"), "split")
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert all(len(r["sha256"]) == 64 for r in files.checksums(spark, str(tmp_path / "out")).collect())
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_jsonl(rows, str(tmp_path / "out"))


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,label\n" a, b ",x\n,y\nc, \n')
    assert [tuple(r) for r in files.read_labelled(spark, str(tmp_path / "a.csv")).collect()] == [("a, b", "x")]
    (tmp_path / "a.md").write_text("# t\n| id | x |\n|-|-|\n| E1 | one |\n| E22 | two |\n")
    assert [r["cells"] for r in files.read_markdown_table(spark, str(tmp_path / "a.md"), r"E\d+").collect()] == [["E1", "one"], ["E22", "two"]]
    (tmp_path / "a.log").write_text("step 10 loss 0.5\nnoise\nstep 20 loss 0.25\n")
    assert [r["groups"] for r in files.read_log_matches(spark, str(tmp_path / "a.log"), r"step (\d+) loss ([\d.]+)").collect()] == [["10", "0.5"], ["20", "0.25"]]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/x.jsonl", "a b\nc\n")
        z.writestr("in/y.txt", "no\n")
    assert [(r["member"], r["line_no"], r["line"]) for r in files.read_zip_lines(spark, str(tmp_path / "a.zip"), ".jsonl").collect()] == [("in/x.jsonl", 0, "a b"), ("in/x.jsonl", 1, "c")]


def test_summaries_and_splits(spark):
    rows = spark.createDataFrame([("a", "train"), ("b", "train"), ("b", "test"), (None, "test")], "source string, split string")
    table = files.registry(spark, [("a", "f", "mit", False), ("b", "f", "mit", True)])
    assert {tuple(r) for r in files.allowed_splits(rows, table).collect()} == {("a", "train"), ("b", "test")}
    assert json.loads(files.stats(rows, ["split"])) == {"split": {"test": 2, "train": 2}}
    assert files.report(spark.createDataFrame([("x", 0.5)], "slice string, acc double")).splitlines()[-1] == "| x | 0.500 |"


def test_resumed_log_holds_each_job_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    for lines in ('{"job": 1, "n": 1}\n{"job": 1, "n": 2}\n{"job": 2, "n": 3}\n{"jo', '{"job": 2, "n": 4}\n{"job": 3, "n": 5}\n', ""):
        if lines:
            (tmp_path / "in" / f"{len(lines)}.json").write_text(lines)
        logs.append_new(logs.follow(spark, source, "job long, n long"), target, mark, "job", "n").awaitTermination()
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(target).collect()) == [(1, 1), (2, 3), (3, 5)]


def test_streamed_windows(spark, tmp_path):
    (tmp_path / "a.json").write_text("".join(json.dumps({"ts": f"2024-01-01 0{h}:30:00", "kind": "k"}) + "\n" for h in (0, 1, 7, 8)))
    stream = spark.readStream.schema("ts timestamp, kind string").json(str(tmp_path))
    out = logs.windowed_counts(stream, "ts", F.col("kind"), "6 hours", "1 hour")
    out.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["n"] for r in spark.table("windows").collect()) == [2, 2]


def test_fitted_temperature(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(3000, 4))
    gold = [int(rng.choice(4, p=np.exp(x) / np.exp(x).sum())) for x in z]
    rows = spark.createDataFrame([((x * 3).tolist(), g) for x, g in zip(z, gold)], "z array<double>, g int")
    assert calibrate.fit_temperature(rows, "z", "g") == pytest.approx(3, rel=0.1)
    assert calibrate.fit_temperature(rows.limit(0), "z", "g") == 1.0


@pytest.mark.parametrize(("p", "a", "b", "want"), [(0.05, 2, 5, 0.06284989), (0.95, 2, 5, 0.58180341), (0.5, 0.5, 0.5, 0.5), (0.05, 30, 3, 0.81605653)])
def test_beta_quantiles(p, a, b, want):
    assert calibrate.beta_quantile(p, a, b) == pytest.approx(want, abs=2e-6)


def test_interval_and_step(spark):
    row = spark.createDataFrame([(0.62, 30.0), (None, 1.0)], "mu double, kappa double")
    low, high = calibrate.beta_interval(F.col("mu"), F.col("kappa"))
    got = row.select(low.alias("low"), high.alias("high"), calibrate.to_step(F.col("mu"), 1.0, 5.0, 1.0).alias("answer")).collect()
    assert 0.4 < got[0]["low"] < 0.62 < got[0]["high"] < 0.8 and got[0]["answer"] == 3.0
    assert got[1]["low"] is None


def test_capped_shares():
    assert calibrate.fill_capped({"a": 1, "b": 1, "c": 2}, {"a": 10, "b": 100, "c": 100}, 120) == {"a": 10.0, "b": pytest.approx(110 / 3), "c": pytest.approx(220 / 3)}
