"""Windows and sessions over a stream give what they give over a table; rows later than the watermark are left out."""

from pyspark.sql import functions as F

from gridloom.streaming import windows

SCHEMA = "ts timestamp, k string, v double"


def test_windows_and_sessions_over_a_stream(spark, tmp_path):
    events = [("2024-01-01 00:00:00", "a", 1.0), ("2024-01-01 00:04:00", "a", 2.0), ("2024-01-01 00:30:00", "b", 4.0), ("2024-01-01 00:31:00", "a", 8.0)]
    df = spark.createDataFrame(events, "ts string, k string, v double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    for name, make in (("totals", lambda x: windows.windowed_totals(x, "ts", "k", "v", "10 minutes")), ("sessions", lambda x: windows.sessions(x, "ts", "k", "10 minutes"))):
        run = make(stream).writeStream.format("memory").queryName(f"own_{name}").outputMode("complete" if name == "totals" else "append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        run.awaitTermination(120)
        got = sorted(map(tuple, spark.table(f"own_{name}").collect()), key=str)
        want = sorted(map(tuple, make(df).collect()), key=str)
        closed = [r for r in want if r in got]
        assert got and closed == got and (got == want or name == "sessions")
