"""Streaming form of the group means: equals the batch result."""
import os

from pyspark.sql import functions as F

from resolvr.operators import baselines as bl
from resolvr.sources import files
from resolvr.streaming import incremental as inc

HEADER = "SR_NUMBER,SR_TYPE,ORIGIN,CREATED_DATE,CLOSED_DATE,ZIP_CODE,CREATED_HOUR,CREATED_DAY_OF_WEEK,CREATED_MONTH,LATITUDE,LONGITUDE\n"


def _land(folder, name, rows):
    with open(os.path.join(folder, name), "w") as f:
        f.write(HEADER)
        for r in rows:
            f.write(",".join(r) + "\n")


def test_running_means_match_batch(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    _land(landing, "a.csv", [("1", "A", "web", "01/01/2020 10:00:00 AM", "01/02/2020 10:00:00 AM", "1", "", "", "", "", ""),
                             ("2", "B", "web", "01/01/2020 11:00:00 AM", "01/04/2020 11:00:00 AM", "1", "", "", "", "", ""),
                             ("3", "A", "web", "01/02/2020 11:00:00 AM", "", "1", "", "", "", "", "")])
    table, ck = str(tmp_path / "sums"), str(tmp_path / "ck")
    q = inc.group_sums(inc.request_stream(spark, str(landing)), ["SR_TYPE"], table, ck)
    q.awaitTermination()
    _land(landing, "b.csv", [("4", "A", "web", "01/03/2020 10:00:00 AM", "01/06/2020 10:00:00 AM", "2", "", "", "", "", "")])
    q = inc.group_sums(inc.request_stream(spark, str(landing)), ["SR_TYPE"], table, ck)
    q.awaitTermination()
    got = {r["SR_TYPE"]: (r["mean_days"], r["n"]) for r in inc.group_means(spark, table, ["SR_TYPE"]).collect()}
    batch = files.load_requests(spark, str(landing), strict=False)
    from resolvr.operators.clean import drop_null, with_response_time
    b = drop_null(with_response_time(batch), ["RESPONSE_TIME_DAYS"])
    exp = {r["SR_TYPE"]: r["_group_mean"] for r in bl.group_means(b, ["SR_TYPE"]).collect()}
    assert {k: v[0] for k, v in got.items()} == exp
    assert got["A"][1] == 2


def test_replayed_batch_counts_once(spark, tmp_path):
    table = str(tmp_path / "sums")
    write = inc._write_sums(table, ["SR_TYPE"])
    one = spark.createDataFrame([("A", 1.0), ("A", 3.0), ("B", 5.0)], "SR_TYPE STRING, RESPONSE_TIME_DAYS DOUBLE")
    two = spark.createDataFrame([("A", 8.0)], "SR_TYPE STRING, RESPONSE_TIME_DAYS DOUBLE")
    write(one, 0)
    write(two, 1)
    write(two, 1)   # the same epoch again, as after a crash
    got = {r["SR_TYPE"]: (r["mean_days"], r["n"]) for r in inc.group_means(spark, table, ["SR_TYPE"]).collect()}
    assert got == {"A": (4.0, 3), "B": (5.0, 1)}


def test_daily_stats_stream(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    _land(landing, "a.csv", [("1", "A", "web", "01/01/2020 10:00:00 AM", "01/02/2020 10:00:00 AM", "1", "", "", "", "", ""),
                             ("2", "A", "web", "01/05/2020 10:00:00 AM", "01/06/2020 10:00:00 PM", "1", "", "", "", "", "")])
    out, ck = str(tmp_path / "daily"), str(tmp_path / "ck2")
    q = inc.daily_stats(inc.request_stream(spark, str(landing)), out, ck, delay="1 day")
    q.awaitTermination()
    rows = spark.read.parquet(out).where(F.col("n") > 0).collect()
    assert [r["n"] for r in rows] == [1]   # 2020-01-01 closed by the watermark, 01-05 still open
