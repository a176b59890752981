import datetime as dt

from lagline.streaming.live import live_campaigns, live_rates


def test_streams_agree_with_batches(spark, tmp_path):
    t0 = dt.datetime(2020, 1, 1)
    rows = [("a", t0 + dt.timedelta(hours=h), y) for h, y in ((0, True), (5, True), (40, True), (41, False), (400, True))]
    spark.createDataFrame(rows, "entity_id string, event_time timestamp_ntz, is_fraud boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entity_id string, event_time timestamp_ntz, is_fraud boolean").parquet(str(tmp_path / "in"))
    for name, df in (("camp", live_campaigns(stream, "24 hours")), ("rates", live_rates(stream))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = [(r["start"].replace(tzinfo=None), r["size"]) for r in spark.table("camp").orderBy("start").collect()]
    assert got == [(t0, 2), (t0 + dt.timedelta(hours=40), 1)]  # the last one is still open
    assert sum(r["positives"] for r in spark.table("rates").collect()) == 3
