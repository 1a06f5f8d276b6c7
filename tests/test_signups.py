"""The absence alerts see every signup: gaps come from moved rows, none is left out."""

from jobsift.plans import binding as B


def test_no_signup_is_left_out(spark):
    spark.createDataFrame([(i, f"2024-01-{i:02d} 05:00:00", i, "signup" if i % 2 else "error", 1.0) for i in range(1, 31)],
                          "event_id long, t string, user_id long, event_type string, value double").selectExpr(
        "event_id", "CAST(t AS TIMESTAMP_NTZ) AS ts", "user_id", "event_type", "value").createOrReplaceTempView("events")
    got = spark.sql(B.SIGNUPS_SQL)
    assert sorted(r["event_id"] for r in got.collect()) == list(range(1, 31, 2))
    days = {r["event_id"]: r["ts"].day for r in got.collect()}
    assert days[5] == 2 and days[15] == 12 and days[25] == 22 and days[7] == 7 and days[29] == 29
