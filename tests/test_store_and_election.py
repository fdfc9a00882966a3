"""Layout election, the versioned store, absorbed deltas, late-bound streams, hot ids."""

from __future__ import annotations

import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from alertlens.config import TIMESTAMP_FORMATS
from alertlens.functions.layouts import attempt, candidates, elect_layouts, layout_votes, parse_elected
from alertlens.functions.text import strip_ws
from alertlens.operators.mart import (
    absorb_files,
    attach_status_name,
    build_mart,
    hot_status_ids,
    load_mart,
    mart_quality,
    refresh_mart,
    write_mart,
)
from alertlens.operators.store import ConflictError, MartStore
from alertlens.plans.dashboard import AlertDashboard
from alertlens.streaming.mart_stream import stream_daily_mart
from tests.conftest import ROOT

FACT = "WW_STATUS_ID bigint, WW_CREATION_TIMESTAMP string, WW_DOMAIN_CODE string"


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame([(1, "New"), (2, "Closed")], "ID bigint, NAME string")


def facts(spark, rows):
    return spark.createDataFrame(rows, FACT)


def texts(spark, rows):
    return facts(spark, [(1, t, "A") for t in rows])


def days(spark, dim, rows):
    mart = build_mart(texts(spark, rows), dim, elect=True)
    return sorted((r.dt_creation.isoformat(), r.Count) for r in mart.collect())


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


# -- election -----------------------------------------------------------------------

def test_the_column_decides_day_or_month(spark, dim):
    assert days(spark, dim, ["01/13/2024", "01/12/2024"]) == [("2024-01-12", 1), ("2024-01-13", 1)]
    assert days(spark, dim, ["13/01/2024", "01/12/2024"]) == [("2024-01-13", 1), ("2024-12-01", 1)]
    assert days(spark, dim, ["01/12/2024", "02/12/2024"]) == [("2024-12-01", 1), ("2024-12-02", 1)]  # a tie: listed order


def test_rows_fall_back_in_mixed_columns(spark, dim):
    got = days(spark, dim, ["01/13/2024", "01/14/2024", "25/12/2024", "2024-01-02", "2024-01-02T10:00:00Z", "junk", "", None,
                            "-2024-01-02", " 01/05/2024 "])
    assert got == [("2024-01-02", 2), ("2024-01-05", 1), ("2024-01-13", 1), ("2024-01-14", 1), ("2024-12-25", 1)]


def test_votes_count_rows_by_layout(spark):
    fact = texts(spark, ["01/13/2024", "01/12/2024", "2024-01-02", "junk", None])
    votes = {r.layout: r.votes for r in layout_votes(fact).collect() if r.votes}
    assert votes == {"MM/dd/yyyy": 2, "dd/MM/yyyy": 1}
    assert elect_layouts(fact) == ("MM/dd/yyyy", "dd/MM/yyyy")
    assert elect_layouts(texts(spark, ["99/99/2024", None])) == ()
    assert elect_layouts(texts(spark, ["2024-01-02", "junk", None])) == TIMESTAMP_FORMATS  # nothing to decide
    assert elect_layouts(texts(spark, []), formats=["yyyy|MM|dd"]) == ()


def test_excluded_rows_do_not_vote(spark, dim):
    fact = facts(spark, [(1, "01/13/2024", "X")] * 3 + [(1, "13/01/2024", "A"), (1, "01/12/2024", "A")])
    mart = build_mart(fact, dim, excluded_domain="X", elect=True)
    assert sorted(r.dt_creation for r in mart.collect()) == [dt.date(2024, 1, 13), dt.date(2024, 12, 1)]


def test_guards_change_no_result(spark):
    made = spark.range(12).selectExpr("timestamp'2024-01-01 03:04:05.123' + make_interval(0,0,0,cast(id*29 as int)) AS ts")
    rows = [r.t for f in candidates() for r in
            made.select(F.date_format("ts", f.replace("[", "").replace("]", "")).alias("t")).limit(3).collect()]
    rows += ["", "x", "1/2/2024", "2024-1-2", "99/99/2024", "2024-02-30", " 2024-01-02", "+2024", "2024/1/2", "201/2/2024x"]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select(strip_ws(F.col("t")).alias("t"))
    plain = lambda f: F.when(~F.substring("t", 1, 1).isin("+", "-"), F.try_to_timestamp("t", F.lit(f))).cast("timestamp_ntz")
    differ = df.select(*[(~attempt(F.col("t"), f).eqNullSafe(plain(f))).cast("int").alias(f"c{k}")
                         for k, f in enumerate(candidates())])
    assert sum(sum(r) for r in differ.collect()) == 0
    both = df.select(parse_elected(F.col("t"), TIMESTAMP_FORMATS).alias("a"), F.coalesce(*[plain(f) for f in TIMESTAMP_FORMATS]).alias("b"))
    assert both.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_typed_columns_hold_no_election(spark, dim):
    fact = texts(spark, ["x"]).withColumn("WW_CREATION_TIMESTAMP", F.lit(dt.date(2024, 1, 2)))
    assert build_mart(fact, dim, elect=True).first().dt_creation == dt.date(2024, 1, 2)


def test_dashboard_elects(spark, dim):
    with AlertDashboard.from_tables(spark, texts(spark, ["01/13/2024", "01/12/2024"]), dim) as dash:
        assert [r.month for r in dash.available_months().select(F.col("value").alias("month")).collect()] == [1]
        plain = dash.panels()
        got = dash.refresh()
        assert {k: sorted(map(str, v)) for k, v in got.items()} == {k: sorted(map(str, v.collect())) for k, v in plain.items()}


# -- quality by year -------------------------------------------------------------------

def test_quality_of_some_years(spark, dim, tmp_path, capsys):
    fact = facts(spark, [(1, "2024-01-02", "A"), (9, "2024-03-02", "A"), (1, "2023-01-02", "A"), (1, "2024-01-02", "X"),
                         (1, "junk", "A"), (1, None, "A")])
    assert tuple(mart_quality(fact, dim, excluded_domain="X", years=[2024]).first()) == (3, 1, 0, 0, 2, 1)
    assert tuple(mart_quality(fact, dim, excluded_domain="X", years=[1999]).first()) == (0, 0, 0, 0, 0, 0)
    typed = fact.withColumn("WW_CREATION_TIMESTAMP", F.expr("try_cast(WW_CREATION_TIMESTAMP AS timestamp_ntz)"))
    typed.write.parquet(str(tmp_path / "fact"))
    rows = mart_quality(spark.read.parquet(str(tmp_path / "fact")), dim, excluded_domain="X", years=[2024])
    assert tuple(rows.first()) == (3, 1, 0, 0, 2, 1)
    rows.explain("formatted")
    pushed = [x for x in capsys.readouterr().out.splitlines() if "PushedFilters" in x]
    assert any("GreaterThanOrEqual(WW_CREATION_TIMESTAMP" in x for x in pushed)


# -- the store ---------------------------------------------------------------------------

def test_a_reader_between_write_and_switch_sees_the_old_mart(spark, dim, tmp_path, monkeypatch):
    path = str(tmp_path / "mart")
    old, new = build_mart(texts(spark, ["2024-01-02"]), dim), build_mart(texts(spark, ["2024-01-03"] * 2), dim)
    write_mart(old, path)
    seen = []
    commit = MartStore.commit
    monkeypatch.setattr(MartStore, "commit", lambda self, change, **k: (seen.append(load_mart(spark, path).collect()), commit(self, change, **k))[1])
    before = load_mart(spark, path)
    write_mart(new, path)
    assert seen == [old.collect()] and before.collect() == old.collect()  # a frame read earlier stays whole
    assert same(load_mart(spark, path), new)


def test_a_killed_write_leaves_the_mart_whole(spark, dim, tmp_path, monkeypatch):
    path = str(tmp_path / "mart")
    old = build_mart(texts(spark, ["2024-01-02", "2023-01-02"]), dim)
    write_mart(old, path)

    def killed(self, change, **k):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(MartStore, "commit", killed)
        for job in (lambda: write_mart(build_mart(texts(spark, ["2022-01-01"]), dim), path),
                    lambda: refresh_mart(texts(spark, []), dim, path, [2023, 2024])):
            with pytest.raises(KeyboardInterrupt):
                job()
    assert same(load_mart(spark, path), old)
    store = MartStore(spark, path)
    assert store.vacuum(keep=1, older_than_hours=24) == 0
    assert store.vacuum(keep=1, older_than_hours=-1) >= 1  # what the killed job wrote
    assert same(load_mart(spark, path), old)


def test_two_writers_both_count(spark, dim, tmp_path):
    path = str(tmp_path / "mart")
    write_mart(build_mart(texts(spark, ["2024-01-02"]), dim), path)
    store, other = MartStore(spark, path), MartStore(spark, path)
    delta = build_mart(texts(spark, ["2024-01-02", "2025-01-02"]), dim)
    raced = []

    def change_of(fresh):
        def change(m):
            if not raced:  # the other writer publishes between our read and our rename
                raced.append(other.append(delta))
            years = dict(m["years"])
            for y, f in fresh.items():
                years[y] = [*years.get(y, []), f]
            return {**m, "years": years}
        return change

    assert store.commit(change_of(store._write(delta)))
    got = {(r.dt_creation.year, r.Count) for r in load_mart(spark, path).collect()}
    assert got == {(2024, 3), (2025, 2)}
    with pytest.raises(ConflictError):
        store.commit(lambda m: other.append(delta) and {**m, "number": m["number"]}, tries=2)


def test_deltas_add_up_once(spark, dim, tmp_path):
    source, path = str(tmp_path / "in a%20b"), str(tmp_path / "mart")
    parts = [["2024-01-02", "2023-05-06"], ["2024-01-02", "2022-01-01"], ["2024-01-02"]]
    rows = []
    for part in parts:
        texts(spark, part).coalesce(1).write.mode("append").parquet(source)
        rows += part
        assert len(absorb_files(spark, source, dim, path)) >= 1
        assert absorb_files(spark, source, dim, path) == []
        assert same(load_mart(spark, path), build_mart(texts(spark, rows), dim))
    store = MartStore(spark, path)
    assert store.compact() == ["2024"] and store.compact() == []
    assert all(len(f) == 1 for f in store.manifest()["years"].values())
    assert same(load_mart(spark, path), build_mart(texts(spark, rows), dim))
    assert absorb_files(spark, source, dim, path) == []  # the ledger outlives compaction
    store.vacuum(keep=1, older_than_hours=-1)
    assert same(load_mart(spark, path), build_mart(texts(spark, rows), dim))
    refresh_mart(texts(spark, ["2024-01-05"]), dim, path, [2024])
    assert {(r.dt_creation.isoformat(), r.Count) for r in load_mart(spark, path).collect()} == {
        ("2024-01-05", 1), ("2023-05-06", 1), ("2022-01-01", 1)}


def test_a_second_absorber_does_not_count_twice(spark, dim, tmp_path, monkeypatch):
    source, path = str(tmp_path / "in"), str(tmp_path / "mart")
    texts(spark, ["2024-01-02"]).write.parquet(source)
    commit, raced = MartStore.commit, []

    def late(self, change, **k):
        if not raced:
            raced.append(True)
            absorb_files(spark, source, dim, path)
        return commit(self, change, **k)

    monkeypatch.setattr(MartStore, "commit", late)
    with pytest.raises(ConflictError):
        absorb_files(spark, source, dim, path)
    assert load_mart(spark, path).first().Count == 1


def test_year_selection_reaches_a_mart_with_deltas(spark, dim, tmp_path, capsys):
    path = str(tmp_path / "mart")
    write_mart(build_mart(texts(spark, ["2024-01-02", "2023-01-02"]), dim), path)
    MartStore(spark, path).append(build_mart(texts(spark, ["2024-01-02"]), dim))
    chosen = load_mart(spark, path).filter(F.col("year_creation") == 2024)
    assert [r.Count for r in chosen.collect()] == [2]
    chosen.explain("formatted")
    assert capsys.readouterr().out.count("PartitionFilters: [isnotnull(year_creation") == 2


def test_empty_marts(spark, dim, tmp_path):
    path = str(tmp_path / "mart")
    write_mart(build_mart(texts(spark, []), dim), path)
    assert load_mart(spark, path).count() == 0
    MartStore(spark, path).append(build_mart(texts(spark, []), dim), stream="s", batch_id=0)
    assert load_mart(spark, path).columns == ["year_creation", "mth_creation", "dt_creation", "NAME", "Count"]


# -- streams --------------------------------------------------------------------------------

def test_append_stream_with_a_large_dimension(spark, dim, tmp_path):
    """A hot id and NULL ids, a repeated dimension id, no broadcast: closed days equal the batch."""
    rows = ([(1, f"2024-01-{d:02d}", "A") for d in range(1, 9)] * 20 + [(2, "2024-01-03", "A"), (None, "2024-01-03", "A"),
            (9, "2024-01-04", "A"), (1, "2024-01-20", "A")])
    fact = facts(spark, rows).withColumn("WW_CREATION_TIMESTAMP", F.to_timestamp("WW_CREATION_TIMESTAMP"))
    fact.write.parquet(str(tmp_path / "in"))
    twice = dim.unionByName(dim.filter("ID = 2"))
    args = {"dim": twice, "status_col": "WW_STATUS_ID", "output_mode": "append", "watermark": "2 days",
            "sink_path": str(tmp_path / "out"), "checkpoint_path": str(tmp_path / "ckpt")}
    want = build_mart(fact, twice).filter("dt_creation < '2024-01-18'")
    for _ in range(2):  # the second run finds nothing new
        got = stream_daily_mart(spark, str(tmp_path / "in"), fact.schema, "", "WW_CREATION_TIMESTAMP", broadcast_max_rows=0, **args)
        assert same(got, want)


def test_a_batch_is_added_once(spark, dim, tmp_path):
    store = MartStore(spark, str(tmp_path / "mart"))
    delta = build_mart(texts(spark, ["2024-01-02"]), dim)
    assert [store.append(delta, stream="a", batch_id=k) for k in (0, 0, 1, 0)] == [True, False, True, False]
    assert store.append(delta, stream="b", batch_id=0)
    assert store.load().first().Count == 3


@pytest.mark.parametrize("mode", ["complete", "append"])
def test_a_status_added_between_two_batches_gets_its_name(spark, tmp_path, mode):
    source, names = str(tmp_path / "in"), str(tmp_path / "dim")
    more = {"output_mode": mode, "watermark": "1 day"} if mode == "append" else {}

    def arrive(rows, status):
        fact = facts(spark, rows).withColumn("WW_CREATION_TIMESTAMP", F.to_timestamp("WW_CREATION_TIMESTAMP"))
        fact.write.mode("append").parquet(source)
        spark.createDataFrame([status], "ID bigint, NAME string").write.mode("append").parquet(names)
        return stream_daily_mart(spark, source, fact.schema, "", "WW_CREATION_TIMESTAMP", sink_path=str(tmp_path / "out"),
                                 checkpoint_path=str(tmp_path / "ckpt"), dim=lambda: spark.read.parquet(names),
                                 status_col="WW_STATUS_ID", **more)

    first = arrive([(1, "2024-01-02", "A"), (2, "2024-01-10", "A")], (1, "New"))
    assert ("New", 2) in [(r.NAME, r.dt_creation.day) for r in first.collect()]
    second = arrive([(2, "2024-01-20", "A"), (2, "2024-01-30", "A")], (2, "Late"))
    got = {(r.dt_creation.day, r.NAME) for r in second.collect()}
    assert (10, "Late") in got and (20, "Late") in got and (2, "New") in got and all(n for _, n in got)


# -- hot ids -----------------------------------------------------------------------------------

def test_hot_ids_are_found(spark):
    fact = facts(spark, [(1, "x", "A")] * 60 + [(None, "x", "A")] * 30 + [(k, "x", "A") for k in range(2, 12)])
    assert hot_status_ids(fact, most=10) == [1]
    assert hot_status_ids(fact.limit(0)) == []


@pytest.mark.parametrize("repeat", [1, 3])
def test_hot_ids_join_where_they_lie(spark, tmp_path, repeat, capsys):
    rows = [(1, "x", "A")] * 300 + [(None, "x", "A")] * 100 + [(k % 50 + 2, "x", "A") for k in range(600)]
    facts(spark, rows).withColumn("k", F.monotonically_increasing_id()).write.parquet(str(tmp_path / "fact"))
    fact = spark.read.parquet(str(tmp_path / "fact"))
    dim = spark.createDataFrame([(k, f" s{k} ") for k in range(40)] * repeat, "ID bigint, NAME string")
    before = spark.conf.get("spark.sql.adaptive.skewJoin.enabled")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        got = attach_status_name(fact, dim, broadcast_max_rows=0, hot_ids=10)
        assert same(got, attach_status_name(fact, dim))
        got.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and (("BroadcastHashJoin" in plan) == (repeat == 1))
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", before)


# -- jobs and the entry ----------------------------------------------------------------------------

def test_cli_mart_absorb_vacuum(spark, dim, tmp_path, capsys):
    from alertlens.__main__ import main

    source, statuses, out = str(tmp_path / "in"), str(tmp_path / "dim"), str(tmp_path / "mart")
    texts(spark, ["01/13/2024", "01/12/2024"]).coalesce(1).write.parquet(source)
    dim.write.parquet(statuses)
    common = ["--alert-header", source, "--statuses", statuses, "--out", out]
    assert main(["mart", *common, "--quality"]) == 0
    assert "all years: rows_read 2" in capsys.readouterr().out
    assert {r.dt_creation.month for r in load_mart(spark, out).collect()} == {1}
    assert main(["mart", *common, "--no-election"]) == 0
    assert {r.dt_creation.month for r in load_mart(spark, out).collect()} == {12}
    assert main(["mart", *common, "--years", "2024", "--quality"]) == 0
    assert "2024: rows_read 2" in capsys.readouterr().out
    added = ["--alert-header", source, "--statuses", statuses, "--out", str(tmp_path / "added")]
    for new in (1, 0):
        assert main(["absorb", *added]) == 0
        assert f"{new} new files" in capsys.readouterr().out
    assert main(["vacuum", "--mart", out, "--keep", "1", "--older-than-hours", "-1"]) == 0
    assert load_mart(spark, out).count() == 2


def test_entry_survives_a_missing_package():
    code = ("import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; "
            "q = e.queries(); print(len(q), 'pipeline' in q, 'daily_mart' in q, set(e.oracle_sql()) <= set(q))")
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120,
                          env=os.environ | {"PYTHONPATH": ROOT})
    from alertlens.plans.catalog import QUERIES

    assert done.stdout.split() == [str(len(QUERIES)), "False", "True", "True"], done.stderr
    assert "public_tokenizers" in done.stderr
