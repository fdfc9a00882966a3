"""Readers, validation and the daily mart: golden values and edge cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

from alertlens.operators.mart import (
    attach_status_name,
    build_mart,
    daily_mart,
    exclude_domain,
    load_mart,
    materialize_mart,
    with_creation_ts,
)
from alertlens.plans.catalog import clean_mart, dirty_mart
from alertlens.sources import fixtures as fx
from alertlens.sources.readers import SchemaError, normalize_headers, read_alert_header
from tests.conftest import SF001, SF01


def _totals(mart):
    r = mart.agg(F.count(F.lit(1)).alias("rows"), F.sum("Count").alias("total"),
                 F.sum(F.when(F.col("NAME").isNull(), F.col("Count"))).alias("nulls")).first()
    return r["rows"], r["total"], r["nulls"] or 0


# -- golden values (FIXTURES.md) -------------------------------------------------------

@pytest.mark.parametrize("sf_dir,kind,expected", [
    (SF001, "clean", (1140, 1206, 0)),
    (SF01, "clean", (7570, 12004, 0)),
    (SF001, "dirty", (883, 904, 99)),
    (SF01, "dirty", (7086, 8890, 1123)),
])
def test_mart_golden(spark, sf_dir, kind, expected):
    build = clean_mart if kind == "clean" else dirty_mart
    assert _totals(build(spark, sf_dir)) == expected


@pytest.mark.parametrize("kind", ["clean", "dirty"])
def test_shuffle_path_equals_broadcast_path(spark, kind):
    build = clean_mart if kind == "clean" else dirty_mart
    a = build(spark, SF01)
    b = build(spark, SF01, broadcast_max_rows=0)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_fanout_dimension_same_on_both_paths(spark):
    from alertlens.plans.catalog import q_mart_fanout

    a = q_mart_fanout(spark, SF001)
    dim = spark.read.parquet(f"{SF001}/nation.parquet").select(
        F.col("n_regionkey").cast("bigint").alias("ID"), F.col("n_name").alias("NAME"))
    fact = spark.read.parquet(f"{SF001}/orders.parquet").select(
        (F.col("o_custkey") % 7).alias("WW_STATUS_ID"),
        F.col("o_orderdate").alias("WW_CREATION_TIMESTAMP"),
        F.col("o_orderpriority").alias("WW_DOMAIN_CODE"))
    b = build_mart(fact, dim, excluded_domain=fx.CLEAN_EXCLUDED_DOMAIN, broadcast_max_rows=0)
    assert a.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_years_option_equals_filter(spark):
    full = clean_mart(spark, SF01).filter(F.col("year_creation").isin(1996, 1997))
    pushed = clean_mart(spark, SF01, years=[1996, "1997"])
    assert full.exceptAll(pushed).count() == 0 and pushed.exceptAll(full).count() == 0


def test_years_option_on_text_timestamps(spark):
    full = dirty_mart(spark, SF001).filter(F.col("year_creation") == 1998)
    only = dirty_mart(spark, SF001, years=[1998])
    assert full.exceptAll(only).count() == 0 and only.exceptAll(full).count() == 0


def test_daily_mart_schema_and_order(spark):
    m = daily_mart(fx.clean_fact(spark, SF001), fx.clean_dim(spark, SF001),
                   excluded_domain=fx.CLEAN_EXCLUDED_DOMAIN)
    assert m.columns == ["year_creation", "mth_creation", "dt_creation", "NAME", "Count"]
    types = [f.dataType for f in m.schema.fields]
    assert types == [IntegerType(), IntegerType(), DateType(), StringType(), LongType()]
    rows = m.collect()
    keys = [(r.NAME, r.year_creation, r.mth_creation, r.dt_creation) for r in rows]
    assert keys == sorted(keys)


def test_refresh_mart_rewrites_only_given_years(spark, tmp_path):
    from alertlens.operators.mart import refresh_mart, write_mart

    path = str(tmp_path / "mart")
    full = clean_mart(spark, SF001)
    stale = full.withColumn("Count", F.when(F.col("year_creation") == 1996, F.lit(0))
                            .otherwise(F.col("Count")).cast("bigint"))
    write_mart(stale, path)
    refresh_mart(fx.clean_fact(spark, SF001), fx.clean_dim(spark, SF001), path, [1996],
                 excluded_domain=fx.CLEAN_EXCLUDED_DOMAIN)
    stored = load_mart(spark, path)
    assert stored.exceptAll(full).count() == 0 and full.exceptAll(stored).count() == 0


def test_materialized_mart_round_trip(spark):
    m = clean_mart(spark, SF001)
    stored = materialize_mart(spark, m)
    assert stored.columns == m.columns
    assert stored.exceptAll(m).count() == 0 and m.exceptAll(stored).count() == 0


# -- header normalisation and validation ------------------------------------------------

FACT_SCHEMA = StructType([
    StructField("WW_STATUS_ID", IntegerType()),
    StructField("WW_CREATION_TIMESTAMP", StringType()),
    StructField("WW_DOMAIN_CODE", StringType()),
])
DIM_SCHEMA = StructType([StructField("ID", IntegerType()), StructField("NAME", StringType())])


def _fact(spark, rows, schema=FACT_SCHEMA):
    return spark.createDataFrame(rows, schema)


def _dim(spark, rows):
    return spark.createDataFrame(rows, DIM_SCHEMA)


def test_padded_headers_are_accepted(spark):
    df = spark.createDataFrame([(1, "x")], "` ID ` int, `NAME ` string")
    assert normalize_headers(df).columns == ["ID", "NAME"]
    fact = _fact(spark, [(1, "2024-01-02 03:04:05", "A")]).toDF(
        " WW_STATUS_ID", "WW_CREATION_TIMESTAMP ", " WW_DOMAIN_CODE ")
    mart = build_mart(fact, df, excluded_domain="Z")
    assert mart.first()["NAME"] == "x"


def test_missing_column_names_it(spark):
    fact = _fact(spark, [(1, "2024-01-02", "A")]).drop("WW_DOMAIN_CODE")
    with pytest.raises(ValueError, match=r"Missing columns in alert_header.parquet: \['WW_DOMAIN_CODE'\]"):
        build_mart(fact, _dim(spark, [(1, "x")]))


def test_missing_dimension_column(spark):
    dim = _dim(spark, [(1, "x")]).drop("NAME")
    with pytest.raises(ValueError, match="workflow_statuses.parquet"):
        build_mart(_fact(spark, [(1, "2024-01-02", "A")]), dim)


def test_case_duplicate_headers_rejected(spark):
    df = spark.createDataFrame([(1, 2, "x")], "ID int, id int, NAME string")
    with pytest.raises(SchemaError, match="Ambiguous"):
        normalize_headers(df)


def test_string_key_against_int_key_rejected(spark):
    schema = StructType([StructField("WW_STATUS_ID", StringType()),
                         StructField("WW_CREATION_TIMESTAMP", StringType()),
                         StructField("WW_DOMAIN_CODE", StringType())])
    fact = _fact(spark, [("a", "2024-01-02", "A")], schema)
    with pytest.raises(SchemaError, match="Join key types differ"):
        build_mart(fact, _dim(spark, [(1, "x")]))


def test_reader_validates(spark, tmp_path):
    path = str(tmp_path / "fact.parquet")
    _fact(spark, [(1, "2024-01-02", "A")]).drop("WW_STATUS_ID").write.parquet(path)
    with pytest.raises(ValueError, match="WW_STATUS_ID"):
        read_alert_header(spark, path)


# -- row-level edge cases ---------------------------------------------------------------

def test_domain_rules(spark):
    rows = [
        (1, "2024-01-01 00:00:00", None),
        (1, "2024-01-01 00:00:00", "\tSUSPICIOUS ACTIVITY\n"),
        (1, "2024-01-01 00:00:00", " SUSPICIOUS ACTIVITY "),
        (1, "2024-01-01 00:00:00", "suspicious activity"),
        (1, "2024-01-01 00:00:00", "OTHER"),
    ]
    kept = exclude_domain(_fact(spark, rows)).select("WW_DOMAIN_CODE").collect()
    assert sorted(r[0] for r in kept) == ["OTHER", "suspicious activity"]


def test_timestamp_variants(spark):
    rows = [
        (1, " 2024-03-05 10:11:12 ", "A"),
        (1, "2024-03-05T10:11:12.123", "A"),
        (1, "2024-03-05", "A"),
        (1, "2024/03/05", "A"),
        (1, "05/03/2024", "A"),
        (1, " 2024-03-05 10:11:12\t", "A"),
        (1, "not a date", "A"),
        (1, None, "A"),
    ]
    out = [r.creation_ts for r in with_creation_ts(_fact(spark, rows)).collect()]
    assert out[:6] == [
        dt.datetime(2024, 3, 5, 10, 11, 12), dt.datetime(2024, 3, 5, 10, 11, 12, 123000),
        dt.datetime(2024, 3, 5), dt.datetime(2024, 3, 5), dt.datetime(2024, 3, 5),
        dt.datetime(2024, 3, 5, 10, 11, 12),
    ]
    assert out[6:] == [None, None]


TRICKY_TIMESTAMPS = [
    "2024-03-05", "2024-03-05 10:11:12", "2024-03-05T10:11:12", " 2024-03-05 10:11:12 ",
    "\t2024-03-05 10:11:12\n", "\u00a02024-03-05\u3000", "2024-02-30", "2024-02-30 10:11:12",
    "2024-13-01 00:00:00", "2024-03-05 24:00:00", "2024-03-05 10:11:12.5", "2024-03-05T10:11:12Z",
    "2024-03-05T10:11:12+02:00", "2024-03-05 10:11", "2024/03/05", "2024/03/05 10:11:12",
    "05/03/2024", "05-03-2024 10:11:12", "20240305", "12345678", "2024", "2024-3-5",
    "2024-03-05 1:02:03", "2024-03-0x", "abcd-ef-gh", "not a date", "", " ", None,
    "2024-03-05 10:11:12.123456", "0001-01-01", "9999-12-31 23:59:59",
]


def test_fast_iso_path_equals_layout_chain(spark):
    from alertlens.functions.timestamps import parse_timestamp_text

    df = spark.createDataFrame([(v,) for v in TRICKY_TIMESTAMPS], "t string")
    out = df.select(parse_timestamp_text(F.col("t")).alias("fast"),
                    parse_timestamp_text(F.col("t"), fast_iso=False).alias("chain")).collect()
    assert [r.fast for r in out] == [r.chain for r in out]
    assert out[0].fast == dt.datetime(2024, 3, 5)
    assert out[12].fast == dt.datetime(2024, 3, 5, 8, 11, 12)  # offset converted to UTC


def test_typed_timestamp_columns(spark):
    date_schema = StructType([StructField("WW_STATUS_ID", IntegerType()),
                              StructField("WW_CREATION_TIMESTAMP", DateType()),
                              StructField("WW_DOMAIN_CODE", StringType())])
    ts_schema = StructType([StructField("WW_STATUS_ID", IntegerType()),
                            StructField("WW_CREATION_TIMESTAMP", TimestampNTZType()),
                            StructField("WW_DOMAIN_CODE", StringType())])
    d = _fact(spark, [(1, dt.date(2024, 2, 29), "A"), (1, None, "A")], date_schema)
    t = _fact(spark, [(1, dt.datetime(2024, 2, 29, 23, 59), "A")], ts_schema)
    dim = _dim(spark, [(1, "x")])
    assert [tuple(r) for r in build_mart(d, dim).collect()] == [(2024, 2, dt.date(2024, 2, 29), "x", 1)]
    assert [tuple(r) for r in build_mart(t, dim).collect()] == [(2024, 2, dt.date(2024, 2, 29), "x", 1)]


def test_unmatched_and_null_ids_keep_null_name(spark):
    rows = [(1, "2024-01-01", "A"), (9, "2024-01-01", "A"), (None, "2024-01-01", "A")]
    mart = build_mart(_fact(spark, rows), _dim(spark, [(1, " x ")]))
    got = sorted((r.NAME or "<null>", r.Count) for r in mart.collect())
    assert got == [("<null>", 2), ("x", 1)]


@pytest.mark.parametrize("bmax", [100, 0])
def test_duplicate_dimension_id_doubles(spark, bmax):
    rows = [(1, "2024-01-01", "A")] * 3
    mart = build_mart(_fact(spark, rows), _dim(spark, [(1, "x"), (1, "x")]),
                      broadcast_max_rows=bmax)
    assert [r.Count for r in mart.collect()] == [6]


def test_fact_name_column_is_ignored(spark):
    fact = _fact(spark, [(1, "2024-01-01", "A")]).withColumn("NAME", F.lit("from fact"))
    joined = attach_status_name(fact, _dim(spark, [(1, "from dim")]))
    assert joined.select("NAME").first()[0] == "from dim"
    assert build_mart(fact, _dim(spark, [(1, "from dim")])).first()["NAME"] == "from dim"


def test_name_is_stripped(spark):
    mart = build_mart(_fact(spark, [(1, "2024-01-01", "A")]), _dim(spark, [(1, "\t New \n")]))
    assert mart.first()["NAME"] == "New"


def test_empty_fact_gives_empty_mart_with_schema(spark):
    mart = build_mart(_fact(spark, []), _dim(spark, [(1, "x")]))
    assert mart.count() == 0
    assert mart.columns == ["year_creation", "mth_creation", "dt_creation", "NAME", "Count"]


def test_load_mart_restores_order(spark, tmp_path):
    from alertlens.operators.mart import write_mart

    path = str(tmp_path / "mart")
    write_mart(clean_mart(spark, SF001), path)
    assert load_mart(spark, path).columns == ["year_creation", "mth_creation", "dt_creation",
                                              "NAME", "Count"]


@pytest.mark.parametrize("kind", [DateType(), TimestampNTZType(), "timestamp"])
def test_years_option_on_typed_columns(spark, kind):
    from pyspark.sql.types import TimestampType

    dtype = TimestampType() if kind == "timestamp" else kind
    schema = StructType([StructField("WW_STATUS_ID", IntegerType()),
                         StructField("WW_CREATION_TIMESTAMP", dtype),
                         StructField("WW_DOMAIN_CODE", StringType())])
    values = [dt.datetime(2019, 12, 31, 23, 59), dt.datetime(2020, 1, 1), dt.datetime(2020, 12, 31, 12),
              dt.datetime(2021, 1, 1)]
    if isinstance(dtype, DateType):
        values = [v.date() for v in values]
    fact = spark.createDataFrame([(1, v, "A") for v in values], schema)
    dim = _dim(spark, [(1, "x")])
    got = build_mart(fact, dim, years=[2020]).agg(F.sum("Count")).first()[0]
    assert got == 2
    assert build_mart(fact, dim, years=[2019, 2021]).agg(F.sum("Count")).first()[0] == 2


def test_row_level_join_paths_agree(spark):
    a = attach_status_name(fx.dirty_fact(spark, SF001), fx.dirty_dim(spark))
    b = attach_status_name(fx.dirty_fact(spark, SF001), fx.dirty_dim(spark), broadcast_max_rows=0)
    assert a.count() == 1500
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("kind", ["clean", "dirty"])
def test_mart_total_equals_surviving_alerts(spark, kind):
    if kind == "clean":
        fact, excluded, build = fx.clean_fact(spark, SF01), fx.CLEAN_EXCLUDED_DOMAIN, clean_mart
    else:
        fact, excluded, build = fx.dirty_fact(spark, SF01), fx.DIRTY_EXCLUDED_DOMAIN, dirty_mart
    surviving = with_creation_ts(exclude_domain(fact, excluded)) \
        .filter(F.col("creation_ts").isNotNull()).count()
    assert build(spark, SF01).agg(F.sum("Count")).first()[0] == surviving


def test_broadcast_check_bounds_rows_and_bytes(spark):
    from alertlens.operators.mart import has_at_most

    dim = _dim(spark, [(i, "x" * 100) for i in range(10)])
    assert has_at_most(dim, 10)
    assert not has_at_most(dim, 9)                      # rows over the bound
    assert not has_at_most(dim, 10, max_bytes=500)      # 10 x (8 + 100) bytes
    assert has_at_most(dim, 10, max_bytes=1080)
    assert not has_at_most(dim, 0)
