"""The same sessions and counts on a stream as on a table."""

import datetime

from chronoweave.streaming import sessions


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    minutes = [0, 10, 20, 90, 100, 400]
    rows = [(u, start + datetime.timedelta(minutes=m + u)) for u in (1, 2) for m in minutes]
    late = [(9, start + datetime.timedelta(days=2))]  # moves the watermark past all windows
    for k, part in enumerate((rows, late)):
        spark.createDataFrame(part, "user long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    table = spark.createDataFrame(rows, "user long, ts timestamp")
    for name, make in (("sessions", lambda df: sessions.sessions(df, ["user"], "ts")), ("counts", lambda df: sessions.windowed_counts(df, ["user"], "ts", "1 hour"))):
        stream = spark.readStream.schema("user long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination(120)
        got = sorted(tuple(r) for r in spark.table(name).where("user < 9").collect())
        assert got and got == sorted(tuple(r) for r in make(table).collect())
