"""The request join: customers meet the orders, not the line items."""
from datetime import datetime

from resolvr.sources.tables import requests_from_tables


def write(spark, d):
    day = datetime(1996, 3, 1)
    for name, schema, rows in (
            ("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
             "l_extendedprice double, l_shipdate timestamp",
             [(1, 1, 1, 1, 2.0, 3.0, day), (1, 1, 1, 1, 2.0, 3.0, day), (1, 2, 1, 2, 2.0, 3.0, None), (2, 1, 1, 1, 1.0, 1.0, day),
              (3, 1, 1, 1, 1.0, 1.0, day), (None, 1, 1, 1, 1.0, 1.0, day), (1, None, 1, 1, 1.0, 1.0, day)]),
            ("orders", "o_orderkey long, o_custkey long, o_orderdate timestamp",
             [(1, 7, day), (1, 8, day), (2, None, day), (3, 9, day), (None, 7, day)]),
            ("part", "p_partkey long, p_brand string", [(1, "A"), (1, "B"), (2, None), (None, "C")]),
            ("customer", "c_custkey long, c_nationkey int, c_mktsegment string", [(7, 1, "X"), (8, 2, None), (8, 3, "Z"), (None, 4, "W")])):
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")


def test_repeated_and_null_keys_and_one_shuffle_less(spark, tmp_path):
    write(spark, str(tmp_path))
    got = requests_from_tables(spark, str(tmp_path))
    # order 1: customers 7, 8, 8; part 1 twice, part 2 once; two equal line items and one of part 2
    assert sorted((r.SR_NUMBER, r.SR_TYPE or "", r.ORIGIN or "", r.ZIP_CODE) for r in got.collect()) == sorted(
        [("1-1-1-1", b, o, z) for b in "AB" for o, z in (("X", "1"), ("", "2"), ("Z", "3")) for _ in range(2)]
        + [("1-2-1-2", "", o, z) for o, z in (("X", "1"), ("", "2"), ("Z", "3"))])
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = {k: next(line.index("Join") for line in plan if "Join Inner" in line and k in line) for k in ("c_custkey", "l_orderkey")}
    assert depth["c_custkey"] > depth["l_orderkey"]
