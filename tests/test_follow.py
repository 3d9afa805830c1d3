"""A stream over a growing ledger, its restart, and ledgers of older versions."""

import datetime
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from featurelab.operators.ledger import VERSION, Ledger
from featurelab.streaming import streams

NOW = datetime.datetime(2026, 1, 1)


def test_versions_only_when_something_changed(spark, tmp_path):
    L, out = Ledger(spark, str(tmp_path / "l")), str(tmp_path / "v")
    step = lambda: streams.follow(spark, L.path, out, ("used_in", "edge")).awaitTermination()
    L.append("used_in", [(1, "a"), (1, "b")])
    step()
    step()  # nothing new: no version
    L.append("used_in", [(2, "a")])
    L.append("edge", [("x", "y", "R", 1, None, None, None, None, None)])
    step()
    got = [(r["version"], r["part"], r["rows"]) for r in streams.ledger_versions(spark, out).orderBy("version", "part").collect()]
    assert got == [(1, "used_in", 2), (2, "edge", 1), (2, "used_in", 3)]
    now = {r["part"]: (r["rows"], r["digest"]) for r in streams.current(streams.ledger_versions(spark, out)).collect()}
    whole = L.table("used_in").select(F.bit_xor(F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})))).first()[0]
    assert now["used_in"] == (3, whole) and now["edge"][0] == 1


def test_a_running_query_sees_appends_and_another_goes_on(spark, tmp_path):
    L, out = Ledger(spark, str(tmp_path / "l")), str(tmp_path / "v")
    L.append("used_in", [(1, "a")])

    def until(rows):
        end = time.time() + 60
        while time.time() < end:
            try:
                if rows in {r["rows"] for r in streams.ledger_versions(spark, out).collect()}:
                    return True
            except Exception:  # not there yet
                pass
            time.sleep(0.3)
        return False

    q = streams.follow(spark, L.path, out, ("used_in",), every="200 milliseconds")
    assert until(1)
    L.append("used_in", [(1, "b"), (2, "a")])
    assert until(3)
    q.stop()
    L.append("used_in", [(3, "a")])
    q = streams.follow(spark, L.path, out, ("used_in",), every="200 milliseconds")
    assert until(4)
    q.stop()
    assert streams.ledger_versions(spark, out).count() == 3


def test_older_ledgers_are_brought_up_to_date(spark, tmp_path):
    path = str(tmp_path / "l")
    spark.createDataFrame([("a", "int", 3, 0.0, 1.0, 1.0)], "column string, dtype string, cardinality bigint, missingness_rate double, mean double, std double").write.parquet(f"{path}/column")
    L = Ledger(spark, path)
    L.append("relationship_type", [("MEMBER_OF", "Feature", ["Feature"], "auto", "", False), ("MINE", "Feature", ["Feature"], "auto", "", False), ("MINE", "Feature", ["Feature"], "auto", "", False)])
    assert L.version() == 1 and L.columns().count() == 0
    assert L.migrate(NOW) == ["column: run", "relationship_type: types that are gone or repeated"]
    assert [(r["column"], r["run"]) for r in L.columns().collect()] == [("a", 1)] and L.version() == VERSION
    assert [r["rel_type"] for r in L.table("relationship_type").collect()] == ["MINE"] and L.migrate(NOW) == []
    new = Ledger(spark, str(tmp_path / "n"))
    assert new.migrate(NOW) == [] and new.version() == VERSION


@pytest.mark.parametrize("orders, lines", [("true", "false"), ("o_orderdate = (SELECT min(o_orderdate) FROM orders)", "true"), ("false", "false")])
def test_appends_without_rows_have_versions(spark, sf, tmp_path, orders, lines):
    """No used features; one week, whose experiment is kept; no orders at all."""
    con = duckdb.connect()
    for name, keep in (("orders", orders), ("lineitem", lines), ("part", "true")):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
        con.execute(f"COPY (SELECT * FROM {name} WHERE {keep}) TO '{tmp_path}/{name}.parquet'")
    con = duckdb.connect()
    for name in ("orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["ledger_versions"]).fetchall()
    got = [tuple(r) for r in __spark_entry__.queries()["ledger_versions"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(want) == 3
