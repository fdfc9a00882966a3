"""Losses, join keys, odd column names and a year that becomes empty."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from alertlens.config import TIMESTAMP_FORMATS
from alertlens.functions.text import strip_ws
from alertlens.functions.timestamps import parse_timestamp_text
from alertlens.operators.filters import apply_filters
from alertlens.operators.mart import (
    attach_status_name,
    build_mart,
    duplicate_status_ids,
    load_mart,
    mart_quality,
    refresh_mart,
    write_mart,
)
from alertlens.sources.readers import SchemaError
from alertlens.streaming.mart_stream import daily_counts, stream_daily_mart

FACT = "WW_STATUS_ID bigint, WW_CREATION_TIMESTAMP string, WW_DOMAIN_CODE string"
LAYOUTS = ["2024-01-02 10:00:00.123456789", "2024-01-02T10:00:00.123456789Z", "02/01/2024 10:00", "02-01-2024 10:00",
           "02/01/2024 10:00:00.123", "2024/01/02T10:00:00", "20240102T100000", "20240102 100000",
           "2024-01-02T10:00:00+0100", "2024/1/2"]


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame([(1, "New"), (2, "Closed")], "ID bigint, NAME string")


def facts(spark, rows):
    return spark.createDataFrame(rows, FACT)


def test_everyday_layouts_are_counted(spark, dim):
    mart = build_mart(facts(spark, [(1, t, "A") for t in LAYOUTS]), dim).collect()
    assert [(r.dt_creation, r.Count) for r in mart] == [(dt.date(2024, 1, 2), len(LAYOUTS))]


def test_own_layout(spark, dim):
    fact = facts(spark, [(1, "2024|01|02", "A")])
    assert build_mart(fact, dim).count() == 0
    assert build_mart(fact, dim, formats=["yyyy|MM|dd"]).first().Count == 1


def test_quality_row_adds_up(spark, dim):
    fact = facts(spark, [(1, "2024-01-02", "A"), (9, "2024-01-02", "A"), (1, None, "A"), (1, "junk", "A"),
                         (1, "2024-01-02", None), (1, "2024-01-02", " X ")])
    for rows in (200_000, 0):
        got = mart_quality(fact, dim, excluded_domain="X", broadcast_max_rows=rows).first()
        assert tuple(got) == (6, 2, 1, 1, 2, 1)
    assert tuple(mart_quality(fact.limit(0), dim).first()) == (0, 0, 0, 0, 0, 0)


def test_refresh_removes_a_year_without_alerts(spark, dim, tmp_path):
    path = str(tmp_path / "mart")
    write_mart(build_mart(facts(spark, [(1, "2024-01-02", "A"), (1, "2023-01-02", "A")]), dim), path)
    refresh_mart(facts(spark, [(1, "2024-01-02", "X"), (1, "2023-01-02", "A")]), dim, path, [2024], excluded_domain="X")
    assert [r.year_creation for r in load_mart(spark, path).collect()] == [2023]
    refresh_mart(facts(spark, []), dim, path, [2023])
    assert load_mart(spark, path).count() == 0


@pytest.mark.parametrize("kind", ["double", "boolean", "string", "decimal(20,0)"])
def test_inexact_join_keys_are_refused(spark, dim, kind):
    fact = facts(spark, [(1, "2024-01-02", "A")])
    with pytest.raises(SchemaError):
        build_mart(fact, dim.withColumn("ID", F.col("ID").cast(kind)))
    assert build_mart(fact, dim.withColumn("ID", F.col("ID").cast("int"))).first().NAME == "New"


def test_odd_fact_columns(spark, dim):
    fact = facts(spark, [(1, "2024-01-02", "A")]).withColumn("a.b", F.lit(7)).withColumn("name", F.lit("mine"))
    row = attach_status_name(fact, dim).first().asDict()
    assert row["a.b"] == 7 and row["NAME"] == "New" and "name" not in row


def test_duplicate_ids(spark, dim):
    got = duplicate_status_ids(dim.unionByName(dim.filter("ID = 1"))).collect()
    assert [tuple(r) for r in got] == [(1, 2)]


def test_stream_rules_are_those_of_the_batch(spark, dim):
    fact = facts(spark, [(1, "2024-01-02", "A"), (1, "junk", "A"), (2, "02/01/2024 10:00", " X "), (2, "2024-01-03", "A")])
    fact = fact.withColumn("NAME", F.lit("mine")).withColumnRenamed("WW_DOMAIN_CODE", " WW_DOMAIN_CODE ")
    args = {"dim": dim, "status_col": "WW_STATUS_ID", "domain_col": "WW_DOMAIN_CODE", "excluded_domain": "X"}
    got = daily_counts(fact, "NAME", "WW_CREATION_TIMESTAMP", **args).collect()
    assert sorted(got, key=str) == sorted(build_mart(fact, dim, excluded_domain="X").collect(), key=str)
    with pytest.raises(SchemaError):
        daily_counts(fact.withColumn("WW_STATUS_ID", F.lit("1")), "NAME", "WW_CREATION_TIMESTAMP", **args)


@pytest.mark.parametrize("rows", [200_000, 0])
def test_stream_joins_a_dimension_of_any_size(spark, dim, tmp_path, rows):
    fact = facts(spark, [(1, "2024-01-02", "A")] * 5 + [(2, "2023-01-03", "A"), (9, "2024-01-03", "A"), (None, "2024-01-03", "A")])
    fact.write.parquet(str(tmp_path / "in"))
    twice = dim.unionByName(dim.filter("ID = 1"))  # a repeated id fans out
    got = stream_daily_mart(spark, str(tmp_path / "in"), fact.schema, "", "WW_CREATION_TIMESTAMP", dim=twice,
                            status_col="WW_STATUS_ID", broadcast_max_rows=rows)
    assert sorted(got.collect(), key=str) == sorted(build_mart(fact, twice).collect(), key=str)


@pytest.mark.parametrize("more", [(), ("MMM d, yyyy",)])
def test_digit_switch_only_refuses_signs(spark, more):
    texts = ["+2024-01-02", "-2024-01-02", "2024-01-02", " 2024-01-02 ", "x2024-01-02", "", None, "02/01/2024", "Jan 2, 2024"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    layouts = (*TIMESTAMP_FORMATS, *more)
    plain = F.coalesce(*[F.try_to_timestamp(strip_ws(F.col("t")), F.lit(f)) for f in layouts])
    both = df.select("t", parse_timestamp_text(F.col("t"), layouts).cast("string").alias("a"),
                     plain.cast("timestamp_ntz").cast("string").alias("b")).collect()
    assert [r.t for r in both if r.a != r.b] == ["-2024-01-02"]
    assert all(r.a is None for r in both if r.t and r.t[0] in "+-x")


def test_unusable_items_give_no_rows(spark, dim):
    mart = build_mart(facts(spark, [(1, "2024-01-02", "A")]), dim)
    for chosen in ({"years": ["abc"]}, {"months": ["x"]}, {"years": [None, "2023"]}, {"years": 123456}):
        assert apply_filters(mart, **chosen).count() == 0
    assert apply_filters(mart, years="2024", months=["1", "ALL"], names=" New ").count() == 1


def test_large_dimension_joins_by_shuffle(spark, dim, capsys):
    build_mart(facts(spark, [(1, "2024-01-02", "A")]), dim, broadcast_max_rows=0).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_year_selection_reaches_the_scan(spark, dim, tmp_path, capsys):
    fact = facts(spark, [(1, "2024-01-02", "A")]).withColumn("WW_CREATION_TIMESTAMP", F.lit(dt.datetime(2024, 1, 2)))
    fact.write.parquet(str(tmp_path / "fact"))
    apply_filters(build_mart(spark.read.parquet(str(tmp_path / "fact")), dim), years=[2024]).explain("formatted")
    assert "GreaterThanOrEqual(WW_CREATION_TIMESTAMP" in capsys.readouterr().out
