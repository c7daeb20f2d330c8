"""Every query that has SQL gives the rows DuckDB gives on the same tables."""

import glob
import os

import duckdb
import pytest

from millrace.operators import judged
from millrace.operators.build import greedy_keep
from millrace.plans import audits, examples  # noqa: F401  add to the catalogue
from millrace.plans import judged as judged_plans  # noqa: F401  adds to the catalogue
from millrace.plans.catalogue import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def rows(frame):
    columns = sorted(frame.columns)
    cells = [[None if v != v else v.item() if hasattr(v, "item") else v for v in r] for r in frame[columns].astype(object).itertuples(index=False)]
    return columns, sorted(([round(v, 5) if isinstance(v, float) else v for v in r] for r in cells), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, FOLDER).toPandas()) == rows(duck.sql(SQL[name]).df())


def test_greedy_chain_keeps_both_ends(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {r[0]: r[1] for r in greedy_keep(pairs).collect()} == {1: True, 2: False, 3: True}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_records_of_other_systems(spark):
    rows = spark.createDataFrame([("x", 2.0), ("nonsense", None), (None, 0.4)], "said string, sure double")
    p = judged.verbalised(rows["said"], rows["sure"], ["x", "y", "__NULL__"])
    got = [tuple(r) for r in rows.select(p["x"], p["__NULL__"], p["decision"]).collect()]
    assert got == [(1.0, 0.0, "x"), (0.25, 0.5, "__NULL__"), (0.3, 0.4, "__NULL__")]
    rows = spark.createDataFrame([(0.9, 0.2), (0.3, 0.1), (0.4, 0.2), (0.6, 0.6), (0.0, 0.0)], "x double, y double")
    p = judged.zero_shot({"x": rows["x"], "y": rows["y"]})
    assert [r[0] for r in rows.select(p["decision"]).collect()] == ["x", "__NULL__", "__NULL__", "x", "__NULL__"]


def test_overlap_rule_needs_one_best_option(spark):
    options = [(1, 0.5, True), (1, 0.2, False), (2, 0.5, True), (2, 0.5, False), (3, 0.0, True), (3, 0.0, False), (4, 0.1, True), (4, 0.3, False)]
    got = judged.overlap_rule(spark.createDataFrame(options, "q int, share double, gold boolean"), "q", "share", "gold").first()
    assert tuple(got) == (4, 3, pytest.approx(1 / 3, abs=1e-6), 0.5, pytest.approx(-1 / 6, abs=1e-6))
