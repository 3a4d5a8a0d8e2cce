"""A stream gives what the table gives."""

from pyspark.sql import functions as F

from veritrail.sources.tables import table
from veritrail.streaming.windows import hourly

SF = "/root/testdata/sf0.001"


def test_stream_equals_table(spark, tmp_path):
    events = table(spark, SF, "events").select("ts", "event_type", "value")
    late = events.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    events.unionByName(late).coalesce(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = hourly(source, "1 day").writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.event_type, r.hour): (r.n, round(r.mean_value, 9)) for r in spark.table("hours").collect()}
    assert got == {(r.event_type, r.hour): (r.n, round(r.mean_value, 9)) for r in hourly(events).collect()}
