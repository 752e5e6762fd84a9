"""Typed CSV ingest on the malformed-file fixture."""

import os
import tempfile

from quarry.sources.ingest import narrowed_types, read_csv_typed

TYPES = {"ID": "string", "Severity": "int", "Start_Time": "string", "Distance(mi)": "double", "Junction": "string"}


def test_typed_csv_rules(spark):
    d = tempfile.mkdtemp(prefix="quarry-csv-")
    with open(os.path.join(d, "part-0.csv"), "w") as f:
        f.write("ID,Severity,Start_Time,Distance(mi),Junction\n")
        f.write("A-1,2,2022-03-08 08:00:00,0.5,True\n")                   # good
        f.write("A-2,3,2022-03-08 09:00:00,0.1,False,EXTRA\n")            # too many fields → skipped
        f.write("A-3,1\n")                                               # short → kept with NULLs
        f.write("A-4,4,not a time,x,\n")                                 # bad cells → NULL
        f.write("A-5,2,2022-03-08 10:00:00.123456789,1.5,False\n")        # 9-digit fraction
    df = read_csv_typed(spark, d, TYPES, timestamps=["Start_Time"], booleans=["Junction"])
    rows = {r["ID"]: r for r in df.collect()}
    assert set(rows) == {"A-1", "A-3", "A-4", "A-5"}
    assert rows["A-1"]["Junction"] is True and rows["A-5"]["Junction"] is False
    assert rows["A-3"]["Start_Time"] is None and rows["A-3"]["Severity"] == 1
    assert rows["A-4"]["Start_Time"] is None and rows["A-4"]["Distance(mi)"] is None and rows["A-4"]["Junction"] is None
    assert rows["A-5"]["Start_Time"] is not None
    assert read_csv_typed(spark, d, TYPES, timestamps=["Start_Time"], booleans=["Junction"], row_cap=2).count() == 2


def test_narrowing_plan(spark):
    df = spark.createDataFrame([(1, 300, 70000, 1.5), (100, -5, 2, 2.5)], "a long, b long, c long, x double")
    plan = {r["column"]: r["narrowed_type"] for r in narrowed_types(df).collect()}
    assert plan == {"a": "tinyint", "b": "smallint", "c": "int", "x": "float"}


def test_rows_with_a_field_too_many_are_skipped(spark, tmp_path):
    (tmp_path / "in.csv").write_text("ID,n,x\nA,1,2.5\nB,2,,EXTRA\nC,3,1.5,EXTRA\nD,4\nE,5,NaN\n")
    df = read_csv_typed(spark, str(tmp_path / "in.csv"), {"ID": "string", "n": "int", "x": "double"})
    assert [tuple(r) for r in df.orderBy("ID").collect()] == [("A", 1, 2.5), ("D", 4, None), ("E", 5, None)]
    assert df.select("ID").count() == 3


def test_file_order_over_many_splits(spark, tmp_path):
    from quarry.sources.ingest import read_csv_ordered
    want = []
    for f in range(5):
        lines = []
        for i in range(400 if f != 2 else 0):
            n = f * 1000 + i
            lines.append(f"k{n % 700},{n}" + (",EXTRA" if n % 9 == 0 else ""))
            if n % 9:
                want.append((f"k{n % 700}", n))
        (tmp_path / f"part-{f}.csv").write_text("ID,n\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        for first in (None, 0, 1, 355, 356, 700, 10_000):
            df = read_csv_ordered(spark, str(tmp_path), {"ID": "string", "n": "int"}, first=first)
            rows = df.orderBy("_order").collect()
            assert [(r["ID"], r["n"]) for r in rows] == want[:first], first
            assert len({r["_order"] for r in rows}) == len(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
