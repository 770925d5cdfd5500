"""Counts by tile over a stream of files equal those over the whole table."""

from pyspark.sql import functions as F

from tessera.streaming import tiles


def test_counts_over_a_stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", float(m * 5 - 150), float(m - 30), 1.0) for m in range(60)]
    df = spark.createDataFrame(rows, "ts string, lon double, lat double, value double").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    counts = tiles.tile_counts(stream, 3, "10 minutes", "1 hour")
    query = counts.writeStream.format("memory").queryName("tile_counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = spark.table("tile_counts")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, tiles.tile_counts(df, 3, "10 minutes", "1 hour").collect()))
    assert found.agg(F.sum("n")).first()[0] == 60
