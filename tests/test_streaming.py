"""The streaming form of resampling against the batch form."""

import datetime as dt

from tablescope.operators.series import resample_sum
from tablescope.streaming.resample import resample_stream


def test_stream_equals_batch(spark, tmp_path):
    rows = [("ab"[i % 2], dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), float(i)) for i in range(200)]
    schema = "k string, d timestamp_ntz, v double"
    for part in range(4):
        spark.createDataFrame(rows[part * 50 : part * 50 + 50], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = (
        resample_stream(stream, "d", "v", "W", "k")
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("resampled")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination(120)
    got = {(r["k"], r["period"]): r["value"] for r in spark.table("resampled").collect()}
    batch = resample_sum(spark.createDataFrame(rows, schema), "d", "v", "W", "k").where("value <> 0").collect()
    assert got == {(r["k"], r["period"]): r["value"] for r in batch if (r["k"], r["period"]) in got}
    assert len(got) >= len(batch)
