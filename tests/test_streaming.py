"""Windows of arrivals, those that are still open included."""

from datetime import datetime

from pyspark.sql import functions as F

from tesserae.streaming import ingest

SCHEMA = "bunkr_id string, page_no int, seen_at timestamp"


def test_open_windows_of_several_batches(spark, tmp_path):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    for day, rows in enumerate(([("a", 1), ("a", 1), ("b", 1)], [("c", 2)])):
        # the second batch adds to the open window of the first
        for batch in range(2):
            at = datetime(2025, 12, 30 + day, 10, batch)
            spark.createDataFrame([(k, n, at) for k, n in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{landing}/{batch}")
    stream = ingest.arrivals(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{landing}/*"), late="30 days")
    for _ in range(2):  # nothing is left to do for the second run
        query = stream.writeStream.outputMode("update").foreachBatch(ingest.upsert_windows(out)).option("checkpointLocation", f"{out}-state")
        query.trigger(availableNow=True).start().awaitTermination()
    got = {(r["day"], r["cards"]) for r in ingest.windows(spark, out).select(F.dayofmonth("start").alias("day"), "cards").collect()}
    assert got == {(30, 4), (31, 2)}
